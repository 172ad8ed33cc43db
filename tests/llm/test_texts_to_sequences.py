"""Concatenate and cut, importance resampling and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import PROSE, no_documents, odd_documents
from webloam.llm import concat, infill, resample
from webloam.llm.tokens import default_path

# concatenate and cut


def held_sequences(rows, window):
    """Pieces by sequence, gapless from 0; all sequences full, or of a power of two."""
    room = defaultdict(list)
    for r in rows:
        room[r.sequence_id].append(r)
    for parts in room.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and at & (at - 1) == 0 or at == window
    return room


@pytest.mark.parametrize("window", [2048, 7, 1])
def test_pieces_hold_every_id_once(spark, window):
    library = Tokenizer.from_file(default_path())
    docs = odd_documents(spark).filter("doc_id IS NULL OR doc_id <> 6" if window < 2048 else "true").repartition(3)
    rows = concat.concat_and_cut(docs.withColumn("sequence_id", F.lit("clash")), window=window).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, np.array(ids, "<u4").tobytes()] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, pieces in by_doc.items():
        whole = {ids for d, ids in want if d == doc_id}
        copies = Counter((p.start, p.length) for p in pieces)
        for p in pieces:
            assert any(ids[4 * p.start:4 * (p.start + p.length)] == p.ids and len(ids) == 4 * p.doc_tokens for ids in whole)
            assert (p.opens, p.closes) == (p.start == 0, p.start + p.length == p.doc_tokens)
        assert sum(p.length for p in pieces) == sum(len(ids) // 4 * n for (d, ids), n in want.items() if d == doc_id), copies
    room = held_sequences(rows, window)
    total = sum(r.length for r in rows)
    assert total == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    assert sorted(room) == list(range(total // window + bin(total % window).count("1")))


def test_tail_needs_no_padding():
    for total in range(200):
        cuts = [total - total % 32, *concat.tail_cuts(total, 32), total]
        assert all((b - a) & (b - a - 1) == 0 for a, b in zip(cuts, cuts[1:])) and sorted(cuts) == cuts


def test_sequences_and_their_boundaries(spark):
    pieces = concat.concat_and_cut(odd_documents(spark).filter("doc_id IN (1, 3, 8, 9)"), window=64)
    rows, parts = concat.sequences(pieces, window=64, padding_id=5).collect(), pieces.collect()
    for r in rows:
        own = sorted((p for p in parts if p.sequence_id == r.sequence_id), key=lambda p: p.offset)
        assert bytes(r.ids) == b"".join(bytes(p.ids) for p in own) and r.n_tokens == sum(p.length for p in own)
        assert [(b.offset, b.length, b.doc_id, b.start, b.opens, b.closes) for b in r.boundaries] == [
            (p.offset, p.length, p.doc_id, p.start, p.opens, p.closes) for p in own]
    short = spark.createDataFrame([(1, 0, 3, 0, 0, b"abcdefghijkl", True, True)],
                                  "doc_id long, start long, length long, sequence_id long, offset long, ids binary, opens boolean, closes boolean")
    assert bytes(concat.sequences(short, window=8, padding_id=7).first().ids) == b"abcdefghijkl" + 5 * b"\x07\0\0\0"


def test_nothing_to_cut(spark):
    assert concat.concat_and_cut(no_documents(spark)).count() == 0
    assert concat.sequences(concat.concat_and_cut(no_documents(spark))).count() == 0


# importance resampling


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, targets):
    own = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in targets for b in brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    place = {id(r): k + 1 for k, r in enumerate(fit[:5 * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], place.get(id(r))) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


def test_draw_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = PROSE.split() + ["Été", "漢字", "x" * 90, "don't", "42", "a-b", "\x00", "\x7f{}"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs += [(k, None) for k in range(300, 303)] + [(7, docs[7][1]), (None, PROSE)]
    targets = ["the old kitchen and the village", None, "", "seven wizards boil a strange soup"]
    found = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in targets], "text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(map(tuple, found.collect())) == order(brute_resample(docs, targets))


def test_odd_documents_have_their_features(spark):
    docs = odd_documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    target = spark.createDataFrame([(PROSE, 1)], "text string, doc_id int")
    assert order(map(tuple, resample.resample(docs, target).collect())) == order(brute_resample(texts, [PROSE]))
    assert resample.resample(no_documents(spark), target).count() == 0
    assert order(map(tuple, resample.resample(docs, target.limit(0)).collect())) == order(brute_resample(texts, []))
    with pytest.raises(ValueError):
        resample.features(docs, buckets=100_000)


def test_long_texts_are_scanned_in_stretches():
    rng = random.Random(4)
    for _ in range(200):
        words = [bytes(rng.choice(b"ab") for _ in range(rng.choice((1, 3, 80)))) for _ in range(rng.randint(0, 12))]
        text = b" ".join(words)
        parts = list(resample.segments(resample.collapsed(text), rng.randint(1, 40)))
        got = np.concatenate([np.empty(0, np.uint16), *resample.run_buckets(parts, 1 << 16, resample.crc_table())]) if parts else np.empty(0)
        want = [zlib.crc32(b" ".join(words[i:i + n])) % (1 << 16) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert sorted(got.tolist()) == sorted(want)


# fill in the middle


def brute_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", text
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", text


def test_forms_equal_brute_force_and_come_back(spark):
    rng = random.Random(5)
    bits = ["a", "é", "漢", "😀", "<", ">", "P", "<S", "<M>", " ", "\n", "\\", "<<"]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for k in range(400)] + [(None, "x<y>z"), (5, None), (6, "a<P>b")]
    docs += [(k, rng.choice("aé漢") * rng.randint(100_000, 400_000)) for k in range(500, 506)]
    found = infill.restored(infill.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert order(map(tuple, found)) == order((i, *brute_infill(i, t)) for i, t in docs)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infill_of_odd_documents(spark):
    docs = odd_documents(spark).withColumns({"form": F.lit(1), "output": F.lit(2), "n": F.lit(3)})
    found = infill.restored(infill.fill_in_middle(docs).withColumn("restored", F.lit(0))).collect()
    assert order(map(tuple, found)) == order((r.doc_id, *brute_infill(r.doc_id, r.text)) for r in docs.collect())
    assert infill.restored(infill.fill_in_middle(no_documents(spark))).count() == 0


def test_rotation_is_exact():
    rng = random.Random(6)
    for size in [*range(12), 3 * infill.STRIP + 1]:
        raw = bytes(rng.randrange(256) for _ in range(size))
        for _ in range(20):
            a, m, b = sorted(rng.randint(0, size) for _ in range(3))
            buffer = bytearray(raw)
            infill.rotate(buffer, a, m, b)
            assert buffer == raw[:a] + raw[m:b] + raw[a:m] + raw[b:]


def test_marks_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.checked(marks)
    assert infill.checked(("[[pre]]", "[[suf]]", "[[mid]]"))
