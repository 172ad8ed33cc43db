"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloam.llm.common import blocks, of_block, put_by_block, settled, shelves_for, tuples
from webloam.llm.components import components

WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
#: Signature: bands of rows; a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**16 = 0.9998.
BANDS, ROWS = 16, 4
#: Words are counted in so many buckets, which bounds the table of document frequencies whatever the input.
BUCKETS = 1 << 18
#: Values a draw picks from, texts that are worked on together (their words and shingles are a worker's memory), shingles of a draw at a time.
DRAWS, BATCH, CUT = 1 << 16, 250, 1 << 15
#: Members of a block that are compared within one task.
BLOCK = 400
#: How far a text's draw may lie above what its weight makes likely before all shingles are worked out; steps of 1 in bounds of values.
LIKELY, STEPS = 2, 1000


@functools.cache
def word_characters():
    """Whether a code point is part of a word."""
    import numpy as np

    out = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[m.start():m.end()] = True
    return out


def xxh64(data: bytes, starts, sizes):
    """XXH64 (seed 0) of words of 1 to 31 bytes, at starts in data; the steps of words of equal length are taken together."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    left = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    eights = np.frombuffer(data + bytes(16 + -len(data) % 8), "<u8")

    def lane(at):
        """8 bytes from any place."""
        k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (eights[k] >> shift) | (eights[k + 1] << np.uint64(1) << (np.uint64(63) - shift))

    order = np.argsort(sizes.astype(np.uint8), kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(sizes, minlength=32))])
    out = np.empty(len(starts), np.uint64)
    for size in range(1, 32):
        own = order[edges[size]:edges[size + 1]]
        if not len(own):
            continue
        lanes = [lane(starts[own] + k) for k in range(0, size, 8)]
        h = np.full(len(own), int(p5) + size, np.uint64)
        for x in lanes[:size // 8]:
            h = left(h ^ (left(x * p2, 31) * p1), 27) * p1 + p4
        at = size & ~7
        if size & 4:
            h = left(h ^ ((lanes[-1] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
            at += 4
        for k in range(at, size):
            h = left(h ^ (((lanes[-1] >> np.uint64(k % 8 * 8)) & np.uint64(255)) * p5), 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[own] = h ^ (h >> np.uint64(32))
    return out


def word_memo() -> dict:
    """Hashes of long words."""
    return {}


def word_hashes(texts: list[str], memo: dict):
    """Hashes of the words of all texts in a row, and how many words each text has."""
    import numpy as np
    import xxhash

    lower = [t.lower() for t in texts]
    whole = "\n".join(["", *lower, ""])  # words are found in all texts at once, as WORD would find them in each
    code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    inside = word_characters().take(code)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin = np.cumsum([0, *[len(t) + 1 for t in lower]])
    counts = np.diff(np.searchsorted(edges[::2], begin)).astype(np.int64)
    # where words lie in UTF-8
    more = [np.flatnonzero(code >= x) for x in (0x80, 0x800, 0x10000)]
    edges = edges + sum(np.searchsorted(x, edges) for x in more)
    data, starts, sizes = whole.encode(), edges[::2], edges[1::2] - edges[::2]
    short, long = np.flatnonzero(sizes < 32), np.flatnonzero(sizes >= 32)
    hashes = np.empty(len(starts), np.uint64)
    hashes[short] = xxh64(data, starts[short], sizes[short])
    hashes[long] = [xxhash.xxh64_intdigest(data[i:i + n]) for i, n in zip(starts[long].tolist(), sizes[long].tolist())]
    return hashes >> np.uint64(1), counts


def mixed(x):
    """A 64-bit finaliser."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], memo: Memo, idf):
    """(text, shingle hash, weight) of the distinct shingles of each text, in the order of text and hash.

    A shingle's weight is how often the text has it, times the mean idf of its words. A text of fewer words than SHINGLE is one
    shingle, a text without words none.
    """
    import numpy as np

    words, sizes = word_hashes(texts, memo)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    value = idf[(words & np.uint64(BUCKETS - 1)).astype(np.int64)]
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    full = np.repeat(np.arange(len(texts)), np.maximum(sizes - SHINGLE + 1, 0))
    within = np.arange(len(full)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(sizes - SHINGLE + 1, 0))])[:-1], np.maximum(sizes - SHINGLE + 1, 0))
    at = begin[full] + within
    key, weight = np.zeros(len(at), np.uint64), np.zeros(len(at))
    for k in range(SHINGLE):
        key = mixed(key + words[at + k] + np.uint64(k + 1))
        weight += value[at + k] / SHINGLE
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        keys, weights = [], []
        for t in short:
            own = words[begin[t]:begin[t] + sizes[t]]
            x = np.zeros(1, np.uint64) + np.uint64(sizes[t])
            for w in own:
                x = mixed(x * np.uint64(3) + w)
            keys.append(x[0])
            weights.append(value[begin[t]:begin[t] + sizes[t]].mean())
        full, key, weight = np.concatenate([full, short]), np.concatenate([key, np.array(keys, np.uint64)]), np.concatenate([weight, weights])
    order = np.argsort(key)  # equal shingles of a text weigh the same, so their order does not matter
    order = order[np.argsort(full[order].astype(np.min_scalar_type(len(texts))), kind="stable")]
    full, key, weight = full[order], key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], (full[1:] != full[:-1]) | (key[1:] != key[:-1])]))
    return full[first], key[first], np.add.reduceat(weight, first)


class Sampler:
    """Improved consistent weighted sampling. Each draw's gamma and uniform values are picked, by the shingle's hash, from tables
    of DRAWS values of those distributions.

    A draw takes the shingle of the least value. The exponential of a text's least value is distributed exponentially, with the text's
    weight as rate, so the least value hardly ever exceeds LIKELY - log(weight). Values are worked out for shingles that may lie
    below that, and for all of a text where none does.
    """

    def __init__(self, draws: int = BANDS * ROWS, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, DRAWS)
        self.log_c = np.log(rng.gamma(2, 1, DRAWS))
        self.beta = rng.random(DRAWS)
        self.seeds = rng.integers(1, 1 << 63, (draws, 2), dtype=np.uint64) | np.uint64(1)
        # a value is at least log_c - r - log(weight): that bound in whole steps, rounded down, from tables that stay in the cache
        self.low_c, self.high_r = np.floor(self.log_c * STEPS).astype(np.int16), np.ceil(self.r * STEPS).astype(np.int16)

    def least(self, h, log_w, starts):
        """Of each text, whose shingles begin at starts: the least value, the first shingle that has it, and its level."""
        import numpy as np

        r = self.r[h >> np.uint64(48)]
        beta = self.beta[(h >> np.uint64(32)) & np.uint64(DRAWS - 1)]
        level = np.floor(log_w / r + beta)
        a = self.log_c[(h >> np.uint64(16)) & np.uint64(DRAWS - 1)] - r * (level - beta + 1)
        value = np.minimum.reduceat(a, starts)
        best = np.flatnonzero(a == np.repeat(value, np.diff(np.append(starts, len(a)))))
        best = best[np.searchsorted(best, starts)]  # the first of equal ones in each text
        return value, best, level[best]

    def samples(self, starts, key, weight):
        """A row for each text, a column for each draw: the hash of the shingle and the level that the draw takes."""
        import numpy as np

        out = np.empty((len(starts), len(self.seeds)), np.uint64)
        if not len(starts):
            return out
        bounds, log_w, likely = np.append(starts, len(key)), np.log(weight), LIKELY - np.log(np.add.reduceat(weight, starts))
        limit = np.repeat(likely, np.diff(bounds)) + log_w
        limit = np.clip(np.ceil(limit * STEPS) + 1, -(1 << 15), (1 << 15) - 1).astype(np.int16)
        buffer = np.empty(CUT, np.uint64)

        def candidates(x, m):
            for lo in range(0, len(key), CUT):  # so that temporary arrays stay in the cache
                own = key[lo:lo + CUT]
                h = buffer[:len(own)]
                np.multiply(np.bitwise_xor(own, x, out=h), m, out=h)
                low = self.low_c.take(((h >> np.uint64(16)) & np.uint64(DRAWS - 1)).view(np.int64)) - self.high_r.take((h >> np.uint64(48)).view(np.int64))
                yield np.flatnonzero(low <= limit[lo:lo + CUT]) + lo

        for d, (x, m) in enumerate(self.seeds):
            some, sure = np.concatenate([*candidates(x, m)]), np.zeros(len(starts), bool)
            for _ in range(2):  # shingles that may have the least value, then all of those texts where these were not enough
                edges = np.searchsorted(some, bounds)
                found = np.flatnonzero(edges[1:] > edges[:-1])
                if len(found):
                    value, best, level = self.least((key[some] ^ x) * m, log_w[some], edges[found])
                    out[found, d] = mixed(key[some[best]] + (level.astype(np.int64) + 4096).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    sure[found] = value <= likely[found]
                if sure.all():
                    break
                some = np.flatnonzero(np.repeat(~sure, np.diff(bounds)))
        return out

    def bands(self, starts, key, weight):
        import numpy as np

        s = self.samples(starts, key, weight)
        out = np.empty((len(s), BANDS), np.int64)
        for b in range(BANDS):
            x = np.full(len(s), b, np.uint64)
            for k in range(ROWS):
                x = mixed(x + s[:, b * ROWS + k])
            out[:, b] = x.view(np.int64)
        return out


def parts(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def inverse_frequencies(texts: DataFrame):
    """idf by bucket of words, between 1 and 2: 1 + ln((N + 1) / (n + 1)) / ln(N + 1), n counting documents that have a word of it.

    Counted over all rows; the table has BUCKETS entries, that many at most reach the driver. The bounds keep a shingle that many
    copies share worth at least half of one that a single text has, so large groups of near copies stay similar.
    """
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo, total, rows = word_memo(), np.zeros(BUCKETS, np.int64), 0
        for part in parts(batches):
            words, sizes = word_hashes(part.column(0).to_pylist(), memo)
            pair = np.unique((np.repeat(np.arange(len(sizes)), sizes) << 18) | (words & np.uint64(BUCKETS - 1)).astype(np.int64))
            total += np.bincount(pair & (BUCKETS - 1), minlength=BUCKETS)
            rows += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["bucket", "n"])

    counts = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = int(counts.loc[counts.bucket == -1, "n"].sum())
    table = np.zeros(BUCKETS)
    own = counts[counts.bucket >= 0]
    table[own.bucket.to_numpy()] = own.n.to_numpy()
    return np.clip(1 + np.log((n + 1) / (table + 1)) / np.log(n + 2), 1, 2).astype(np.float32)


def similarity(a_keys, a_weights, b_keys, b_weights) -> float:
    """Weighted Jaccard similarity of two sorted lists of shingles."""
    import numpy as np

    at = np.searchsorted(b_keys, a_keys)
    at[at == len(b_keys)] = 0
    same = b_keys[at] == a_keys if len(b_keys) else np.zeros(len(a_keys), bool)
    shared = np.minimum(a_weights[same], b_weights[at[same]]).sum()
    whole = a_weights.sum() + b_weights.sum() - shared
    return float(shared / whole) if whole else 0.0


def vectors(texts: DataFrame, idf, wanted: str, shelves: int) -> DataFrame:
    """``node``, its shingles' hashes (sorted, 32 bits) and weights, for those rows (id, text) of each block that ``wanted`` names."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memo, table = word_memo(), idf.astype(np.float64)
        for block, held in blocks(tuples(batches), lambda r: len(r[1])):
            named = of_block(wanted, shelves, block, ["node"])
            ids = set(named["node"].to_pylist()) if named is not None else ()
            own = [r for r in held if r[0] in ids]
            for at in range(0, len(own), BATCH):
                some = own[at:at + BATCH]
                text, key, weight = shingles([r[1] for r in some], memo, table)
                ends = np.searchsorted(text, np.arange(len(some) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (
                    pa.array((key >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(weight.astype(np.float32)))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), *lists], ["node", "keys", "weights"])

    return texts.mapInArrow(run, "node long, keys array<int>, weights array<float>")


def verified(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose similarity reaches SIMILARITY."""
    side = lambda n, k: vecs.select(F.col("node").alias(n), F.col("keys").alias(f"k{k}"), F.col("weights").alias(f"w{k}"))

    @F.pandas_udf("double")
    def jaccard(k1, w1, k2, w2):
        import numpy as np
        import pandas as pd

        return pd.Series([similarity(a.view(np.uint32), x, b.view(np.uint32), y) for a, x, b, y in zip(k1, w1, k2, w2)])

    both = pairs.join(side("v", 2), "v").join(side("u", 1), "u")
    return both.filter(jaccard("k1", "w1", "k2", "w2") >= SIMILARITY).select("u", "v")


def unresolved(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node) with ``root``, of keys that still hold two components or more."""
    own = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = own.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select("key")
    return own.join(open_, "key")


def blocks_of(members: DataFrame) -> DataFrame:
    """Members (key, node, root) with ``blk``, a block of about BLOCK members of their key, and ``of``: the root all of the block have, or NULL.

    Members of one component that are more than BLOCK have blocks of their own; smaller components share blocks and stay whole.
    Blocks follow from counts and hashes, so no key or component is numbered in one task.
    """
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_n"))
    large = F.col("_n") > BLOCK
    rest = sizes.filter(~large).groupBy("key").agg(F.sum("_n").alias("_rest"))
    sizes = sizes.join(rest, "key", "left").withColumnRenamed("key", "_key").withColumnRenamed("root", "_root")
    own = F.struct(F.col("root").alias("of"), F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / BLOCK)).alias("part"))
    shared = F.struct(F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("root"), F.ceil(F.col("_rest") / BLOCK)).alias("part"))
    return members.join(sizes, (F.col("key") == F.col("_key")) & (F.col("root") == F.col("_root"))).select(
        "key", "node", "root", F.when(large, own).otherwise(shared).alias("_blk")).select(
        "key", "node", "root", F.col("_blk.of").alias("of"), F.concat_ws("/", "_blk.of", "_blk.part").alias("blk"))


def blockwise(members: DataFrame, vecs: DataFrame) -> DataFrame:
    """All links (u, v) between members (key, node, root) of one key whose roots differ, compared in blocks of about BLOCK.

    A task sees two blocks of one key, so no group meets whole; only links are put out, no pairs. Two blocks of one component
    are not compared: a large component beside few others costs a task for each of its blocks, not for each two.
    """
    own = settled(blocks_of(members), "blocks")
    named = own.select("key", "blk", "of").distinct()
    other = named.select(F.col("key").alias("_key"), F.col("blk").alias("_blk"), F.col("of").alias("_of"))
    pairs = named.join(other, (F.col("key") == F.col("_key")) & (F.col("blk") <= F.col("_blk")) & ~F.coalesce(F.col("of") == F.col("_of"), F.lit(False)))
    pairs = settled(pairs.select("key", F.col("blk").alias("lo"), F.col("_blk").alias("hi")), "block_pairs")
    sides = pairs.withColumn("_b", F.explode(F.array_distinct(F.array("lo", "hi"))))
    tasks = sides.withColumnRenamed("key", "_key").join(own, (F.col("_key") == F.col("key")) & (F.col("_b") == F.col("blk"))).select(
        "key", "lo", "hi", "_b", "node", "root")

    def compare(pdf):
        import numpy as np
        import pandas as pd

        rows = [(b, n, r, np.asarray(k).view(np.uint32), np.asarray(w)) for b, n, r, k, w in zip(pdf["_b"], pdf["node"], pdf["root"], pdf["keys"], pdf["weights"])]
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        group = {n: r for _, n, r, _, _ in rows}  # components as far as they are known here

        def root(x):
            while group.get(x, x) != x and x in group:
                x = group[x]
            return x

        out = []
        for i, (b1, n1, _, k1, w1) in enumerate(rows):
            s1 = w1.sum()
            for b2, n2, _, k2, w2 in rows[i + 1:]:
                s2 = w2.sum()
                if (lo != hi and b1 == b2) or min(s1, s2) < SIMILARITY * max(s1, s2):
                    continue
                a, b = root(n1), root(n2)
                if a != b and similarity(k1, w1, k2, w2) >= SIMILARITY:
                    out.append((n1, n2))
                    group[max(a, b)] = min(a, b)
                    group.setdefault(min(a, b), min(a, b))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return tasks.join(vecs, "node").groupBy("key", "lo", "hi").applyInPandas(compare, "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """``id_col``, ``copy_of`` (the least id of rows with the same text) and ``class_id`` (the least id of its class), for each row.

    Ids are integers; rows of one id are one document. Texts are linked where they share a band and their weighted Jaccard
    similarity is 0.8 or more; classes are the connected components of links and equal texts. NULL texts are empty, and equal
    to each other; texts without words are linked to none. A row without an id is in the class of an equal text that has one, and else in
    none: copy_of and class_id are NULL. Other columns are ignored, an empty table gives no rows.

    Documents are read three times and never shuffled; rows must lie in the same partitions each time, as those of files do.
    Equal texts are one node. Of each band's bucket, first the member with the most company is compared with all others, twice, which
    settles groups around a centre in linear work; members of buckets that then still hold several components are compared in
    blocks, so no link is lost and no pairs are put out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    idf = inverse_frequencies(texts.select("text"))

    def sign(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        memo, table, sampler = word_memo(), idf.astype(np.float64), Sampler()
        for block, held in blocks(tuples(batches), lambda r: len(r[1])):
            for at in range(0, len(held), BATCH):
                some = held[at:at + BATCH]
                text, key, weight = shingles([r[1] for r in some], memo, table)
                known, starts = np.unique(text, return_index=True)
                bands = sampler.bands(starts, key, weight) if len(known) else np.empty((0, BANDS), np.int64)
                ends = np.concatenate([[0], np.cumsum(np.isin(np.arange(len(some)), known) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.int64()), pa.array([hashlib.md5(r[1].encode()).digest() for r in some], pa.binary()),
                     pa.array([block] * len(some), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                    ["id", "same", "block", "bands"])

    signed = settled(texts.mapInArrow(sign, "id long, same binary, block long, bands array<long>"), "signed")
    firsts = signed.groupBy("same").agg(F.min("id").alias("node"))
    nodes = signed.join(firsts, (signed.same == firsts.same) & (signed.id == firsts.node), "left_semi").select(
        F.col("id").alias("node"), "block", "bands").dropDuplicates(["node"])
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = settled(banded.join(shared, "key"), "members")
    # only texts that share a bucket with another are compared; their blocks are told which, so that no text is shuffled
    wanted = settled(members.select("node").distinct().join(nodes.select("node", "block"), "node"), "wanted")
    shelves = shelves_for(signed)
    vecs = settled(vectors(texts, idf, put_by_block(wanted.select("block", "node"), shelves, "named"), shelves).dropDuplicates(["node"]), "vectors")
    if vecs.count() != wanted.count():
        raise RuntimeError("two passes over the documents disagree; settle them first")
    company = members.groupBy("node").agg(F.sum("n").alias("_company"))
    left = settled(members.select("key", "node").join(company, "node"), "left")
    links, roots = None, None
    for _ in range(rounds):
        leaders = left.groupBy("key").agg(F.max(F.struct("_company", "node"))["node"].alias("u"))
        pairs = left.join(leaders, "key").filter(F.col("node") != F.col("u")).select("u", F.col("node").alias("v")).distinct()
        found = settled(verified(pairs, vecs), "links")
        links = found if links is None else links.unionByName(found)
        roots = settled(components(links), "roots")
        rest = unresolved(left.join(leaders, "key").filter(F.col("node") != F.col("u")).select("key", "node", "_company"), roots)
        left = settled(rest.drop("root"), "left")
    found = settled(blockwise(left.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), vecs), "links")
    roots = settled(components(links.unionByName(found)), "roots")
    return signed.select("id", "same").join(firsts, "same").join(roots, "node", "left").select(
        F.col("id").alias(id_col), F.col("node").alias("copy_of"), F.coalesce("root", "node").alias("class_id"))
