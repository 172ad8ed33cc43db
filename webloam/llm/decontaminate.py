"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (lower case). An item is in a document where some stretch of it is within ``rate`` times the item's
words of edits (words put in, left out or changed). A window within that distance shares a number of the item's word runs (the
q-gram lemma), so windows that share fewer with all items of their size are passed over without loss. Each other window walks the
CGK embedding, which maps near word sequences to sequences near in Hamming distance; sampled positions of several walks are its
keys, and items of its size with an equal key are candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WORD = re.compile(r"\w+")
BATCH = 1000
#: Documents' rows are returned for a block of so many items at a time.
BLOCK_ITEMS = 20_000
#: Words of windows that are embedded at once.
CELLS = 4_000_000
#: Positions that a key samples; the least part of a walk's positions in which a window at the allowed distance agrees with its item.
SAMPLED, AGREEMENT = 3, 0.6
#: Keys drawn from one walk.
PER_WALK = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(n_words: int, rate: float) -> int:
    return int(rate * n_words + 1e-9)


def shared_runs(n_words: int, rate: float) -> tuple[int, int]:
    """Run length q and the least number of an item's runs that a stretch within reach shares."""
    edits = allowed(n_words, rate)
    for q in (3, 2):
        least = n_words - q + 1 - q * edits
        if least >= 2:
            return q, least
    return 1, max(1, n_words - edits)


def tables_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT ** SAMPLED))


def edit_distance_within(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such stretch ends (bit-parallel)."""
    m = len(item)
    full, top, at = (1 << m) - 1, 1 << (m - 1), {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = at.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (full & ~(zero | up)), up & zero
        if right_up & top:
            score += 1
        if right_down & top:
            score -= 1
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        up, down = right_down | (full & ~(zero | right_up)), right_up & zero
        if score < best:
            best, end = score, j
    return best, end


class ItemIndex:
    """Items by the keys of their embedding, one size at a time. Holds one block of items, whose number is bounded."""

    def __init__(self, items: list[tuple], rate: float, recall: float, seed: int = 7):
        import numpy as np

        self.rate, self.vocab, self.items, self.sizes, self.repeats, runs = rate, {}, [], {}, set(), {}
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                self.sizes.setdefault(len(ids), []).append(len(self.items))
                self.items.append((item_id, ids))
                q, _ = shared_runs(len(ids), rate)
                if any(len(set(ids[k:k + q + 1])) == 1 for k in range(len(ids) - q)):
                    self.repeats.add(q)
                runs.setdefault(q, {}).setdefault(len(ids), []).extend(zip(*(ids[k:] for k in range(q))))
        # runs of q words by number: those of k + 1 words from the number of their first k, so no key outgrows 64 bits
        self.base, self.starts, self.runs = len(self.vocab) + 1, {}, {}
        for q, by_size in runs.items():
            own = np.array([r for some in by_size.values() for r in some], np.int64).reshape(-1, q)
            key, self.starts[q] = own[:, 0], []
            for k in range(1, q):
                key = key * self.base + own[:, k]
                if k < q - 1:
                    known, key = np.unique(key, return_inverse=True)
                    self.starts[q].append(known)
            self.runs[q, 0], at = np.unique(key), 0
            for m, some in by_size.items():
                self.runs[q, m] = np.unique(key[at:at + len(some)])
                at += len(some)
        self.tables, self.seed = tables_for(recall), seed
        self.longest = max(self.sizes, default=0)
        self.pad = self.longest + allowed(self.longest, rate) + 1
        self.keys = {}
        for m, own in self.sizes.items():
            keys = self.embed(np.array([self.items[k][1] for k in own], np.int64))
            self.keys[m] = [(np.sort(keys[:, t]), np.array(own)[np.argsort(keys[:, t], kind="stable")]) for t in range(self.tables)]

    def embed(self, windows):
        """Keys (a column for each table) of windows of one size: CGK walks, each sampled several times."""
        import numpy as np

        w, m = windows.shape
        steps = max(SAMPLED, round(1.8 * m))
        rng = np.random.default_rng((self.seed, m))
        keys, row = np.empty((w, self.tables), np.int64), np.arange(w)
        for first in range(0, self.tables, PER_WALK):
            mult = rng.integers(1, 1 << 62, steps, dtype=np.int64) | 1
            plus = rng.integers(0, 1 << 62, steps, dtype=np.int64)
            picks = [np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(PER_WALK)][: self.tables - first]
            own = np.zeros((len(picks), w), np.int64)
            at = np.zeros(w, np.int64)
            for j in range(max(int(p[-1]) for p in picks) + 1):
                word = np.where(at < m, windows[row, np.minimum(at, m - 1)], -1)
                for k, p in enumerate(picks):
                    if j in p:
                        own[k] = own[k] * 1_000_003 + word
                at = at + (((word * mult[j] + plus[j]) >> 40) & 1)
            keys[:, first:first + len(picks)] = own.T
        return keys

    def gate(self, ids):
        """Starts of windows by size, out of one long array of word ids (0: no item's word) in which documents lie ``pad`` zeros apart."""
        import numpy as np

        by_length = {}
        for m in self.sizes:
            q, least = shared_runs(m, self.rate)
            by_length.setdefault(q, []).append((m, least, m + allowed(m, self.rate) - q + 1))
        for q, sizes in by_length.items():
            key, known = ids[: len(ids) - q + 1].copy(), ids[: len(ids) - q + 1] > 0
            for k in range(1, q):
                part = ids[k: len(ids) - q + 1 + k]
                key, known = key * self.base + part, known & (part > 0)
                if k < q - 1:
                    known &= self.held(key, self.starts[q][k - 1])
                    key = np.searchsorted(self.starts[q][k - 1], key)
            if q not in self.repeats:  # no item has a run twice in a row, so only the first of such counts
                known[1:] &= (key[1:] != key[:-1]) | ~known[:-1]
            where = np.flatnonzero(known)
            where = where[self.held(key[where], self.runs[q, 0])]
            hit = np.zeros(len(ids) + 1, np.int32)
            hit[where + 1] = 1
            total, last, reach = np.cumsum(hit), len(ids), max(r for _, _, r in sizes)
            # first with the runs of all items, then, at the few places left, with those of each size
            places = np.flatnonzero(total[np.minimum(np.arange(last) + reach, last)] - total[:-1] >= min(t for _, t, _ in sizes))
            for m, least, reach in sizes:
                own = where[self.held(key[where], self.runs[q, m])]
                starts = places[np.searchsorted(own, places + reach) - np.searchsorted(own, places) >= least]
                if len(starts):
                    yield m, starts

    @staticmethod
    def held(keys, known):
        import numpy as np

        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def find(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, word at which the stretch ends) for each item in each text, by its nearest stretch."""
        import numpy as np

        if not self.items:
            return
        get, parts, begins, n = self.vocab.get, [], [], self.pad
        for words in texts:
            begins.append(n)
            parts += [0] * self.pad
            parts += [get(w, 0) for w in words]
            n += len(words) + self.pad
        ids = np.array(parts + [0] * (2 * self.pad), np.int64)
        begins = np.array(begins + [n])
        pairs: dict[tuple[int, int], list[int]] = {}
        for m, starts in self.gate(ids):
            for cut in range(0, len(starts), max(1, CELLS // m)):
                some = starts[cut:cut + max(1, CELLS // m)]
                keys = self.embed(ids[some[:, None] + np.arange(m)])
                for t, (known, own) in enumerate(self.keys[m]):
                    lo, hi = np.searchsorted(known, keys[:, t]), np.searchsorted(known, keys[:, t], side="right")
                    for k in np.flatnonzero(hi > lo):
                        # a window may begin in the gap before its document
                        text = int(np.searchsorted(begins, some[k] + m // 2, side="right")) - 1
                        for item in own[lo[k]:hi[k]]:
                            pairs.setdefault((max(text, 0), int(item)), []).append(int(some[k]))
        for (text, item), places in pairs.items():
            own = self.items[item][1]
            edits = allowed(len(own), self.rate)
            begin, end = int(begins[text]), int(begins[text + 1]) - self.pad
            best, where, stretches = edits + 1, 0, []
            for p in sorted(set(places)):  # windows close together are one stretch
                lo, hi = max(begin, p - 2 * edits - len(own) // 6), min(end, p + len(own) + 2 * edits + len(own) // 6)
                if stretches and lo <= stretches[-1][1]:
                    stretches[-1][1] = max(hi, stretches[-1][1])
                else:
                    stretches.append([lo, hi])
            for lo, hi in stretches:
                found, at = edit_distance_within(own, ids[lo:hi].tolist())
                if found < best:
                    best, where = found, lo + at - begin
            if best <= edits:
                yield text, item, best, where


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", rate: float = 0.2, recall: float = 0.999, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and item that it holds: ``id_col``, ``item_col``, edits, item_words, end_word (long).

    Whole texts against all items, in blocks of about ``block_items``, each of which is sent to the executors; documents are read
    once a block and never shuffled. ``recall``: for a window at the allowed distance, from which the number of keys follows.
    Items may be of any length: their windows are embedded some at a time. NULL and empty texts hold nothing, items without a word are in nothing. Equal items are each reported; repeated documents
    give repeated rows; other columns are ignored; an empty table on either side gives no rows.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind, item_kind = dict(rows.dtypes)[id_col], dict(items.dtypes)[item_col]
    item_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits long, item_words long, end_word long"
    asked = items.select(F.col(item_col), F.col(item_text_col))
    blocks = max(1, -(-asked.count() // block_items))
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64(F.col(item_col), F.col(item_text_col)), F.lit(blocks)) == b) if blocks > 1 else asked
        block = [tuple(r) for r in own.collect()]

        def search(batches: Iterator, block=block) -> Iterator:
            import pyarrow as pa

            index = ItemIndex(block, rate, recall)
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    found = list(index.find([words_of(t) for t in part.column(1).to_pylist()]))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array([f[0] for f in found], pa.int32())), pa.array([index.items[f[1]][0] for f in found], item_type),
                             *[pa.array(x, pa.int64()) for x in ([f[2] for f in found], [len(index.items[f[1]][1]) for f in found], [f[3] for f in found])]],
                            [id_col, item_col, "edits", "item_words", "end_word"])

        some = rows.mapInArrow(search, schema)
        out = some if out is None else out.unionByName(some)
    return out
