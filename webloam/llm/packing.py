"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloam.llm.common import settled
from webloam.llm.tokens import default_path, word_bpe

CAPACITY = 2048
BATCH = 1000


class CapacityTree:
    """Open bins by remaining capacity; finds the tightest capacity that takes a length in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.bins = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.size
        while at:
            self.bins[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that an open bin has."""
        at = length + self.size
        if self.bins[at]:
            return length
        while at > 1:  # up to the first right neighbour that holds a bin, then down to its leftmost one
            if at % 2 == 0 and self.bins[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.bins[2 * at])
                return at - self.size
            at //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths: steps (length, first piece, first bin, pieces a bin, offset), and the bins used.

    A step's pieces are numbered among those of their length; piece p of it goes to bin ``first bin + (p - first piece) // pieces a bin``.
    Pieces of equal length are placed together: the tightest bin takes pieces until it is full for them (placing one makes it
    tighter still), then the next. So a run of equal bins is filled in one step, and work follows the number of
    distinct lengths and capacities, which ``capacity`` bounds, not the number of pieces.
    """
    tree, runs, steps, used = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            runs.setdefault(remaining, []).append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(counts, reverse=True):
        left, piece = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, bins = capacity, used, -(-left // (capacity // length))
                used += bins
            else:
                first, bins = runs[remaining].pop()
                tree.add(remaining, -bins)
            each = remaining // length
            full = min(bins, left // each)
            if full:
                steps.append((length, piece, first, each, capacity - remaining))
                put(remaining - each * length, first, full)
                piece, left = piece + full * each, left - full * each
            if full < bins and left:  # the last pieces go to one bin
                steps.append((length, piece, first + full, left, capacity - remaining))
                put(remaining - left * length, first + full, 1)
                piece, left, full = piece + left, 0, full + 1
            put(remaining, first + full, bins - full)
    return steps, used


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 closing_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each text: ``id_col``, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A text's ids (NULL: empty) are followed by ``closing_id``; only texts longer than ``capacity`` are cut, each ``capacity`` ids.
    An empty text is one piece of the closing id alone. Other columns are ignored, repeated rows give repeated rows.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)[id_col]
    close = closing_id.to_bytes(4, "little")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = word_bpe(vocabulary or default_path())
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                rows, number, start, length, ids = [], [], [], [], []
                gc.disable()  # nothing below makes cycles, and walking the memos is slow
                for k, text in enumerate(texts):
                    own = bpe.ids(text) + close
                    for p, cut in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[cut:cut + 4 * capacity]
                        rows.append(k)
                        number.append(p)
                        start.append(cut // 4)
                        length.append(len(piece) // 4)
                        ids.append(piece)
                gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())], [id_col, "piece", "start", "length", "ids"])

    return rows.mapInArrow(encode, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (long): best-fit decreasing over all of them, no sequence above ``capacity``.

    Lengths must be from 1 to ``capacity``; a row of another or NULL length keeps NULL in both. Columns of those two names are
    replaced. Rows of equal length are numbered in a fixed but free order. Only the histogram of lengths, at most ``capacity``
    rows, reaches the driver; the plan it yields is bounded likewise. Rows are numbered within the partition they were
    settled in, so one length on most rows is no hot group.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    at = "_settled"
    rows = settled(pieces.select(*own, F.spark_partition_id().alias(at)), "pieces")
    fits = F.col(length_col).between(1, capacity)
    here = rows.filter(fits).groupBy(at, length_col).agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in here.groupBy(length_col).agg(F.sum("_n")).collect()}
    steps, _ = plan_bins(counts, capacity)
    earlier = Window.partitionBy(length_col).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    base = here.select(F.col(at).alias("_at"), F.col(length_col).alias("_length"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    order = Window.partitionBy(at, length_col).orderBy(length_col)
    ranked = rows.withColumn("_rank", F.row_number().over(order)).join(
        base, (F.col(at) == F.col("_at")) & (F.col(length_col) == F.col("_length")), "left") \
        .withColumn("_piece", (F.col("_base") + F.col("_rank") - 1).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, piece):
        import numpy as np
        import pandas as pd

        # steps as one sorted list of (length, first piece); a row belongs to the last step that isn't beyond it
        table = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5)
        known = (length.notna() & piece.notna()).to_numpy()
        n, p = length.fillna(1).to_numpy(np.int64), piece.fillna(0).to_numpy(np.int64)
        out = pd.DataFrame({"sequence_id": pd.array([None] * len(n), dtype="Int64"), "offset": pd.array([None] * len(n), dtype="Int64")})
        for value in np.unique(n[known]):
            own = known & (n == value)
            mine = table[table[:, 0] == value]
            step = mine[np.searchsorted(mine[:, 1], p[own], side="right") - 1]
            k = p[own] - step[:, 1]
            out.loc[own, "sequence_id"] = step[:, 2] + k // step[:, 3]
            out.loc[own, "offset"] = step[:, 4] + k % step[:, 3] * value
        return out

    placed = ranked.withColumn("_placed", place(F.when(fits, F.col(length_col)).cast("long"), F.col("_piece")))
    return placed.select(*own, F.col("_placed.sequence_id").alias("sequence_id"), F.col("_placed.offset").alias("offset"))
