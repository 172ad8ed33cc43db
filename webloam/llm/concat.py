"""Concatenate and cut: texts' tokens one after another, cut into windows of equal length."""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloam.llm.common import settled
from webloam.llm.tokens import default_path, word_bpe

WINDOW = 2048
BATCH = 1000
#: Partition totals (16 bytes each) that are sent to all executors; where there are more, Spark joins them its own way.
SENT_PARTITIONS = 1 << 20


def token_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", closing_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """First pass. ``id_col``, ``part`` (the partition), ``before`` (tokens of earlier rows of it), ``n_tokens`` (long) and ``ids`` (binary,
    little-endian unsigned 32-bit, the closing id last) of each row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)[id_col]
    close = closing_id.to_bytes(4, "little")

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe, part, total = word_bpe(vocabulary or default_path()), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                gc.disable()  # nothing below makes cycles, and walking the memo is slow
                ids = [bpe.ids(t) + close for t in some.column(1).to_pylist()]
                gc.enable()
                n = np.array([len(x) // 4 for x in ids], np.int64)
                before = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())],
                    [id_col, "part", "before", "n_tokens", "ids"])

    return rows.mapInArrow(encode, f"`{id_col}` {kind}, part long, before long, n_tokens long, ids binary")


def tail_cuts(total: int, window: int) -> list[int]:
    """Where the rest after the last whole window is cut: into runs whose lengths are powers of two, the longest first."""
    rest, at, cuts = total % window, total - total % window, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return cuts[:-1]


def concat_and_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, closing_id: int = 1,
                   vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each text: ``id_col``, start, length, doc_tokens, sequence_id, offset (long), ids (binary, little-endian unsigned
    32-bit), opens and closes (boolean: the text begins, ends in this piece).

    All texts' ids, each followed by ``closing_id``, lie one after another and are cut every ``window`` ids, wherever that is. What is
    left after the last whole window makes sequences whose lengths are powers of two, so no sequence needs padding. NULL texts
    are empty: one closing id. A NULL id is kept, repeated rows are texts of their own, other columns are ignored, an empty table
    gives no rows. The order is that of the rows' partitions.

    Two passes: texts are encoded once, and a row learns how many tokens its partition had before it; prefix sums over the
    partitions' totals then give each row its place among all. A piece is cut where a row's own place crosses a window's edge, so no
    row is shuffled and a text of any length is cut inside its row.
    """
    runs = settled(token_runs(docs, id_col, text_col, closing_id, vocabulary), "runs")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = settled(runs.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        F.col("part").alias("_part"), "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "totals")
    parts, total = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    bases = totals.select("_part", "_base")
    placed = runs.join(F.broadcast(bases) if parts <= SENT_PARTITIONS else bases, F.col("part") == F.col("_part"))

    body, tail = total - total % window, F.array(*[F.lit(x).cast("long") for x in tail_cuts(total, window)])
    first = F.col("_base") + F.col("before")
    last = first + F.col("n_tokens")
    edge = (F.floor(first / window).cast("long") + 1) * window
    top = F.least(last - 1, F.lit(body))
    inner = F.when(edge <= top, F.sequence(edge, top, F.lit(window).cast("long"))).otherwise(F.array().cast("array<long>"))
    cuts = F.concat(F.array(first), inner, F.filter(tail, lambda x: (x > first) & (x < last)), F.array(last))

    def piece(k: Column) -> Column:
        at = F.get("_cuts", k)
        start, length = at - F.col("_first"), F.get("_cuts", k + 1) - at
        passed = F.filter(tail, lambda x: x <= at)
        rest = F.struct((F.lit(body // window) + F.size(passed)).cast("long").alias("sequence_id"),
                        (at - F.coalesce(F.array_max(passed), F.lit(body))).alias("offset"))
        whole = F.struct(F.floor(at / window).cast("long").alias("sequence_id"), (at % window).alias("offset"))
        own = F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * length).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), own.alias("ids"), F.when(at < body, whole).otherwise(rest).alias("place"))

    pieces = placed.select(id_col, "n_tokens", "ids", first.alias("_first"), cuts.alias("_cuts")).select(
        id_col, "n_tokens", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), piece)).alias("_piece"))
    start, length = F.col("_piece.start"), F.col("_piece.length")
    return pieces.select(
        id_col, start.alias("start"), length.alias("length"), F.col("n_tokens").alias("doc_tokens"), F.col("_piece.place.sequence_id").alias("sequence_id"),
        F.col("_piece.place.offset").alias("offset"), F.col("_piece.ids").alias("ids"), (start == 0).alias("opens"),
        (start + length == F.col("n_tokens")).alias("closes"))


def sequences(pieces: DataFrame, id_col: str = "doc_id", window: int = WINDOW, padding_id: int = 0) -> DataFrame:
    """A row for each sequence of pieces: ``sequence_id``, ``n_tokens`` (without padding), ``ids`` (binary) and its boundary records
    ``boundaries`` array<struct<offset, length, id_col, start, opens, closes>> in order.

    Sequences are padded to ``window`` ids, but those whose length is a power of two are not. A group holds ``window`` pieces at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", id_col, "start", "opens", "closes", "ids")))
    whole = F.aggregate("_parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    n = F.col("n_tokens").cast("int")
    padding = F.unhex(F.repeat(F.lit(padding_id.to_bytes(4, "little").hex()), F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(window) - n)))
    return pieces.groupBy("sequence_id").agg(parts.alias("_parts"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens", F.concat(whole, padding).alias("ids"),
        F.transform("_parts", lambda p: F.struct(*[p[c].alias(c) for c in ("offset", "length", id_col, "start", "opens", "closes")])).alias("boundaries"))
