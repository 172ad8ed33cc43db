"""Shards along a Hilbert curve over several metadata dimensions, so that files prune on each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloam.llm.common import block_of, map_blocks, put_by_block, settled, shelves_for, with_running

#: Bits to which each dimension is quantised.
BITS = 5


def curve_index(cells, bits: int):
    """Hilbert index of points, by the transposed form of the curve: cells is a list of integer arrays, one a dimension."""
    import numpy as np

    x = [np.array(c, dtype=np.int64) for c in cells]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = (index << 1) | ((c >> b) & 1)
    return index


def ordinal(column: Column, kind: str) -> Column:
    """What orders as the column does: a number, or the string itself."""
    if kind == "string":
        return column
    if kind in ("date", "timestamp"):
        return F.unix_timestamp(column).cast("double")
    return column.cast("double")


def string_cuts(df: DataFrame, column: str, parts: int) -> list[str]:
    """The values at which the share of rows up to them reaches 1, 2, ... parts - 1 of ``parts``; at most that many reach the driver.

    Exact: distinct values are counted, and running totals over their order tell which of them hold a cut.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    placed = settled(with_running(counts, [column], ["_n"], "strings"), "strings")
    total = placed.agg(F.sum("_n")).first()[0] or 1
    share = lambda n: F.floor(n * parts / total)
    last = F.col("_n_before") + F.col("_n")
    held = placed.filter((share(last) > share(F.col("_n_before"))) & (share(F.col("_n_before")) < parts - 1))
    return sorted(r[0] for r in held.select(column).collect())


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df with ``_cell_<d>`` (int): which of 2**bits - 1 quantile ranges a value lies in, from 1; 0 for NULL.

    Quantiles are over all rows, of numbers in one aggregate, of strings by their counts; equal values share a cell.
    """
    kinds, parts = dict(df.dtypes), (1 << bits) - 1
    share = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    texts, numbers = [d for d in dims if kinds[d] == "string"], [d for d in dims if kinds[d] != "string"]
    found = {d: string_cuts(df, d, parts) for d in texts}
    if numbers:
        cuts = df.select(*[ordinal(F.col(d), kinds[d]).alias(d) for d in numbers]).agg(*[F.percentile_approx(d, share, F.lit(1_000)).alias(d) for d in numbers]).first()
        found |= {d: sorted(set(cuts[d] or [])) for d in numbers}

    def cell(d: str) -> Column:
        value = ordinal(F.col(d), kinds[d])
        empty = F.array().cast("array<string>" if d in texts else "array<double>")
        edges = F.array(*[F.lit(x) for x in found[d]]) if found[d] else empty
        return F.when(value.isNull(), 0).otherwise(1 + F.size(F.filter(edges, lambda e: e < value))).cast("int").alias(f"_cell_{d}")

    return df.select("*", *[cell(d) for d in dims])


def hilbert(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df with ``_curve`` (long): the index of the row's cell on the Hilbert curve over ``dims``."""

    @F.pandas_udf("long")
    def index(cells):
        import pandas as pd

        return pd.Series(curve_index([cells.iloc[:, k].to_numpy() for k in range(len(dims))], bits))

    cells = [f"_cell_{d}" for d in dims]
    return quantised(df, dims, bits).withColumn("_curve", index(F.struct(*cells))).drop(*cells)


def shard(docs: DataFrame, shards: int, dims: list[str], text: str, size: Column, tie: str, whole: float = 0.125) -> DataFrame:
    """Rows of docs with ``shard`` (int) and their keys ``_curve``, ``_group``, ``_size``: runs of the curve of near equal ``size``.

    Rows go by the curve index of their group (the least of its rows' dimensions stand for all, so that equal rows stay together),
    then by group, then by ``tie``. A row's shard follows from the sizes before it, so shards differ by a row at most;
    a cut inside a group moves to the group's start where the group takes no more than ``whole`` of a shard's share, and
    leaves it in two shards where it takes more. Groups are equal values of the column ``text``. NULLs of dimensions are cells of their
    own. Nothing but the cuts (one row a shard) reaches the driver; only keys and sizes are ordered, and a row learns its group's
    index in its block, so rows are not shuffled here.
    A column named shard is replaced; repeated rows stay together; an empty table gives none.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot", "_curve", "_group", "_size", "_part")]
    keyed = docs.select(*own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_group"), size.cast("long").alias("_size"))
    groups = keyed.groupBy("_group").agg(F.min(F.struct(*dims)).alias("_dims"), F.sum("_size").alias("_all"))
    curved = settled(hilbert(groups.select("_group", "_all", *[F.col("_dims")[d].alias(d) for d in dims]), dims).select("_group", "_all", "_curve"), "curve")
    keys = ["_curve", "_group", tie]
    ordered = with_running(keyed.select("_group", "_size", tie).join(curved, "_group"), keys, ["_size"], "order")
    total = F.lit(ordered.agg(F.sum("_size")).first()[0] or 1)
    n = F.least(F.floor(F.col("_size_before") * shards / total), F.lit(shards - 1)).cast("int")
    cuts = [r for r in ordered.withColumn("_n", n).filter("_n > 0").groupBy("_n").agg(
        F.min(F.struct("_curve", "_group", tie, F.when(F.col("_all") * shards > total * whole, F.lit(True)).otherwise(F.lit(False)).alias("split"))).alias("cut")
    ).orderBy("_n").collect()]

    def beyond(cut) -> Column:
        """Is the row at the cut or behind it?"""
        row, at = F.struct("_curve", "_group"), F.struct(F.lit(cut["_curve"]).alias("_curve"), F.lit(cut["_group"]).alias("_group"))
        if not cut["split"]:
            return row >= at
        at_tie = F.col(tie).isNull() if cut[tie] is None else F.col(tie) >= F.lit(cut[tie])
        return (row > at) | ((row == at) & F.coalesce(at_tie, F.lit(False)))

    shard_of = F.lit(0)
    for r in cuts:
        shard_of = F.when(beyond(r["cut"]), int(r["_n"])).otherwise(shard_of)
    placed = settled(block_of(keyed.select(F.col("_group").alias("id"), F.coalesce(text, F.lit("")).alias("text"))), "placed")
    shelves = shelves_for(placed)
    path = put_by_block(placed.distinct().join(curved.select(F.col("_group").alias("id"), "_curve"), "id"), shelves, "curves")

    def add_index(rows, groups, found):
        import numpy as np
        import pyarrow as pa

        known, curve = found["id"].to_numpy(), found["_curve"].to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known, np.array(groups, np.int64), sorter=order)]
        if not (known[at] == np.array(groups, np.int64)).all():
            raise RuntimeError("two passes over the documents disagree; settle them first")
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(curve[at])], [*rows.schema.names, "_curve"])

    schema = T.StructType([*keyed.schema.fields, T.StructField("_curve", T.LongType())])
    indexed = map_blocks(keyed, "_group", text, path, shelves, ["id", "_curve"], add_index, schema)
    return indexed.withColumn("shard", shard_of.cast("int")).select(*own, "shard", "_curve", "_group", "_size")


def write_shards(docs: DataFrame, path: str, shards: int, dims: list[str], text: str, size: Column, tie: str, whole: float = 0.125) -> DataFrame:
    """Write the shards (folders ``shard=<n>``, files in the order of the curve), and read them back.

    A shard's rows lie in as many files as ranges of the order fall into it, so shards may grow beyond one task.
    """
    placed = shard(docs, shards, dims, text, size, tie, whole)
    keys = ["shard", "_curve", "_group", tie]
    rows = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def with_slots(written: DataFrame, tie: str) -> DataFrame:
    """Rows of written shards with ``slot`` (long): how many rows of the shard stand before them."""
    files = written.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    here = Window.partitionBy("shard", "_part").orderBy("_curve", "_group", tie)
    return written.withColumn("_row", F.row_number().over(here)).join(bases, ["shard", "_part"]) \
        .withColumn("slot", (F.col("_base") + F.col("_row") - 1).cast("long")).drop("_base", "_row", "_part", "_curve", "_group", "_size")
