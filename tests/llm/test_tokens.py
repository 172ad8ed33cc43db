"""Token counts, pieces and packing against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import no_documents, odd_documents
from webloam.llm import packing, prefix_counts
from webloam.llm.tokens import WordBpe, default_path

BITS = ["a", "th", "é", "'s", "'re", "don't", "ß", "İ", "Σ", "漢", "<|endoftext|>", "<|", "12", "½", " ", "\n", "\t", "\x1c", "!!", "$", "한", "ᄒ",
        "ᅡ", "😀", "ing", "Ǆ", "ﬁ", "é", "\u0085", "X", "e\u0301", "\u0323", "\u0301", "\u0345", "\xa0", "\u2000", "\r",
        "ก\u0e31", "\u09c7\u09be", "\u11a8", "\u212b", "\u023a", "'", "r", "e", "v", "l", "'l", "<|startoftext|>", "endoftext|>", "\xad", "²", "\u200d",
        "\u017f", "\u01c5"]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(default_path())


def test_ids_and_every_prefix_equal_the_library(bpe):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        count = lambda t: len(bpe.library.encode(t, add_special_tokens=False).ids)
        assert list(np.frombuffer(bpe.ids(text), np.uint32)) == bpe.library.encode(text, add_special_tokens=False).ids, repr(text)
        assert list(bpe.prefix_counts(text)) == [count(text[:k]) for k in range(len(text) + 1)], repr(text)


def test_words_in_any_order_of_a_batch(bpe):
    words = "shall shame sham shampoo she sheet s shalls".split()
    bpe.remember([" ".join(words)])
    for w in words:
        assert bpe.prefix_counts(w)[-1] == len(bpe.library.encode(w, add_special_tokens=False).ids)


def test_long_words_take_linear_time(bpe):
    import time

    start = time.perf_counter()
    bpe.prefix_counts("かな漢字" * 5000)
    assert time.perf_counter() - start < 30


def test_prefixes_of_documents(spark):
    library = Tokenizer.from_file(default_path())
    rows = prefix_counts.token_prefixes(odd_documents(spark)).withColumns({
        "n": prefix_counts.n_tokens(F.col("prefix_tokens")), "fit": prefix_counts.longest_prefix(F.col("prefix_tokens"), 3),
        "ten": prefix_counts.tokens_of_first(F.col("prefix_tokens"), 10)}).collect()
    assert len(rows) == odd_documents(spark).count()
    for r in rows:
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert r.n == count(r.text) and len(r.prefix_tokens) == len(r.text) + 1
        assert r.ten == count(r.text[:10]) and count(r.text[:r.fit]) <= 3
        if len(r.text) < 1000:
            assert r.fit == max(k for k in range(len(r.text) + 1) if count(r.text[:k]) <= 3)
    assert prefix_counts.token_prefixes(no_documents(spark)).count() == 0


def test_tree_finds_the_tightest_bin():
    rng = random.Random(4)
    tree, bins = packing.CapacityTree(50), []
    for _ in range(600):
        if bins and rng.random() < 0.4:
            gone = rng.choice(bins)
            bins.remove(gone)
            tree.add(gone, -1)
        else:
            bins.append(rng.randint(0, 50))
            tree.add(bins[-1], 1)
        need = rng.randint(1, 50)
        assert tree.tightest(need) == min((b for b in bins if b >= need), default=None)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_the_plan_uses_as_many_bins_as_piece_by_piece():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(4, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        counts = {n: lengths.count(n) for n in lengths}
        steps, used = packing.plan_bins(counts, capacity)
        assert used == best_fit_decreasing(lengths, capacity)
        room = {}
        for n in counts:
            own = sorted(s for s in steps if s[0] == n)
            for p in range(counts[n]):
                _, first, bin_, each, offset = [s for s in own if s[1] <= p][-1]
                k = p - first
                room.setdefault(bin_ + k // each, []).append((offset + k % each * n, n))
        for parts in room.values():  # gapless, and within the capacity
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        assert sum(map(len, room.values())) == len(lengths)


def test_pieces_and_sequences_of_documents(spark):
    docs = odd_documents(spark)
    library = Tokenizer.from_file(default_path())
    rows = packing.pack(packing.token_pieces(docs).withColumn("sequence_id", F.lit("clash"))).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.start), r)
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), packing.CAPACITY):
            own, r = ids[start:start + packing.CAPACITY], pieces.pop((doc_id, start))
            assert (r.length, r.piece) == (len(own), start // packing.CAPACITY)
            assert zlib.crc32(bytes(r.ids)) == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    assert not pieces
    room = {}
    for r in rows:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(room) == best_fit_decreasing([r.length for r in rows], packing.CAPACITY)
    assert packing.pack(packing.token_pieces(no_documents(spark))).count() == 0


def test_lengths_that_cannot_be_packed(spark):
    rows = packing.pack(spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 11), (5, 5)], "id int, length long"), capacity=10).collect()
    assert {r.id: r.sequence_id is not None for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert len({r.sequence_id for r in rows if r.id in (1, 5)}) == 1
