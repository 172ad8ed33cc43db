"""Importance resampling towards a target: hashed n-gram features from overlapped regex scans, log ratios of their counts, Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.llm.common import settled, with_running

BUCKETS = 10_000
#: A run of up to three words that stands between spaces; scanned with overlap it is found once at each word.
RUN = regex.compile(rb"(?<= )[^ ]+(?: [^ ]+){0,2}(?= )")
ORDER = 3
#: Lower-cases A-Z; what is neither a digit, a letter nor beyond ASCII becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of a text that are scanned at once, and of short texts that are hashed together.
SEGMENT, SLAB = 4 << 20, 1 << 20
#: Bytes of a word that are hashed step by step with those of other words; longer ones go one by one.
LONG = 64


def collapsed(text: bytes) -> bytes:
    """Words of the text, a single space before and after each."""
    words = text.translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def segments(words: bytes, size: int = SEGMENT) -> Iterator[tuple[bytes, int]]:
    """The collapsed text in stretches of about ``size`` bytes, and how many words at the end only complete the runs of earlier ones."""
    at, extra = 0, 0
    while at < len(words) - 1:
        cut = words.find(b" ", min(at + size, len(words) - 1))
        end, extra = cut, 0
        while extra < ORDER - 1 and end < len(words) - 1:
            end, extra = words.find(b" ", end + 1), extra + 1
        yield words[at:end + 1], extra
        at = cut


def crc_table():
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc_on(crc, raw: bytes, starts, ends, table):
    """CRC-32 of many byte strings at once, each going on from ``crc`` over raw[start:end]."""
    import numpy as np

    data, sizes = np.frombuffer(raw, np.uint8), ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], -sizes[order]
    state = ~crc[order]
    far = int(np.searchsorted(left, -LONG))  # longer than LONG
    for k in range(far):
        state[k] = ~np.uint32(zlib.crc32(raw[at[k]:at[k] - left[k]], int(~state[k])))
    for k in range(LONG):
        live = int(np.searchsorted(left, -k))
        if live <= far:
            break
        now = state[far:live]
        state[far:live] = table[(now ^ data[at[far:live] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def run_buckets(slab: list[tuple[bytes, int]], buckets: int, table) -> list:
    """For each (collapsed words, extra) the buckets of its runs of one to three words, but those that begin at the extra words."""
    import numpy as np

    raw = b"".join(words for words, _ in slab)
    spans, counts, base = [], [], 0
    for words, _ in slab:
        own = [m.span() for m in RUN.finditer(raw, base, base + len(words), overlapped=True)]
        spans += own
        counts.append(len(own))
        base += len(words)
    span = np.array(spans, np.int64).reshape(-1, 2)
    counts = np.array(counts)
    starts, n = span[:, 0], len(span)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the stretch
    used = left > np.repeat([extra for _, extra in slab], counts)
    # a run of fewer words than the one found ends before the next word's start
    ends, crc, found = starts, np.zeros(n, np.uint32), []
    for k in range(1, ORDER + 1):
        some = left >= k
        after = np.minimum(np.arange(n) + k, n - 1)
        end = np.where(left > k, starts[after] - 1, span[:, 1])
        crc = crc.copy()
        crc[some] = crc_on(crc[some], raw, ends[some], end[some], table)
        ends = end
        found.append((some & used, crc % np.uint32(buckets)))
    first = np.concatenate([[0], np.cumsum(counts)])
    keep, values = np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1).astype(np.uint16)
    return [values[a:b][keep[a:b]] for a, b in zip(first, first[1:])]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``id_col``, n_words, n_features (long) and ``features`` (binary: the bucket of each run of one to three words, 2 bytes little-endian).

    A run's bucket is the CRC-32 of its words, joined by one space, modulo ``buckets`` (65,536 at most). Words are lower-cased in A-Z
    only. Repeats are kept. NULL and wordless texts have none; repeated rows give repeated rows. Texts are scanned in stretches, so
    memory is bounded beside the text and its features.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be from 1 to 65536")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)[id_col]

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = crc_table()

        def found(texts) -> Iterator:
            """(number of the text, words, its buckets or a part of them)."""
            slab, whose, size = [], [], 0
            for k, text in enumerate(texts):
                for words, extra in segments(collapsed(text)):
                    slab.append((words, extra))
                    whose.append(k)
                    size += len(words)
                    if size >= SLAB:
                        yield from zip(whose, run_buckets(slab, buckets, table))
                        slab, whose, size = [], [], 0
            if slab:
                yield from zip(whose, run_buckets(slab, buckets, table))

        for batch in batches:
            out = [[] for _ in range(batch.num_rows)]
            for k, values in found(batch.column(1).cast(pa.binary()).to_pylist()):
                out[k].append(values.astype("<u2").tobytes())
            out = [b"".join(x) for x in out]
            n = np.array([len(x) // 2 for x in out], np.int64)
            words = np.where(n > 3, n // 3 + 1, (n + 1) // 2)  # 3w - 3 runs of w words, 1 of one and 3 of two
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(out, pa.binary())], [id_col, "n_words", "n_features", "features"])

    return rows.mapInArrow(scan, f"`{id_col}` {kind}, n_words long, n_features long, features binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS):
    """How often each bucket occurs, as a numpy array: counted in each task first, so that ``buckets`` rows at most leave one."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = found.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


def gains(source, target) -> list[int]:
    """floor(1000 ln of how much likelier the target is to have a bucket than the source), both with one added to each bucket."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())]


def weighed(found: DataFrame, gain: list[int], id_col: str = "doc_id") -> DataFrame:
    """``found`` with ``weight`` (long): the sum of its features' gains, in place of the features."""
    columns = [c for c in found.columns if c not in ("features", "weight")]
    rows = found.select(*columns, "features")
    schema = found.select(*columns).withColumn("weight", F.lit(0).cast("long")).schema

    def weigh(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        value = np.array(gain, np.int64)
        for batch in batches:
            sums = [int(value[np.frombuffer(x, "<u2")].sum()) for x in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*columns, "weight"])

    return rows.mapInArrow(weigh, schema)


def gumbel(id_col: str, seed: str) -> Column:
    """floor(1000 g), g a Gumbel variate that follows from the seed and the id (NULL: an empty one)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5,
             least_words: int = 20, seed: str = "42", buckets: int = BUCKETS) -> DataFrame:
    """``id_col``, n_features, weight, score and rank (long; NULL: not drawn) of each row.

    weight: the sum of the gains of its features. score: the weight plus a Gumbel variate times 1000, so that the highest scores are a
    draw without replacement by weight. Of rows of ``least_words`` words or more, ``percent`` of 100 are drawn, rounded down; ties go to
    the smaller id, NULL first, equal ids in any order. NULL and empty texts have no features, weight 0 and are never drawn.
    Without a target text all buckets count alike there. Other columns are ignored, an empty table gives no rows.

    Texts are scanned once; their features, two bytes each, are settled, since gains need the counts of all. Only counts of
    ``buckets`` buckets reach the driver. The draw numbers narrow rows over a range partitioning.
    """
    found = settled(features(docs, id_col, text_col, buckets), "features")
    wanted = features(target.select(F.lit(0).alias("_id"), F.col(target_text)), "_id", target_text, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    rows = settled(weighed(found, gain, id_col).withColumn("score", F.col("weight") + gumbel(id_col, seed)), "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * rows.filter(fit).count() // 100
    ranked = with_running(rows.filter(fit).withColumn("_least", -F.col("score")), ["_least", id_col], [], "draw")
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    out = [id_col, "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(rows.filter(~fit).select(*out, F.lit(None).cast("long").alias("rank")))
