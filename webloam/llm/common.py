"""Helpers the operators share: where intermediate tables go, and running totals over an order of all rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


#: Characters of documents that make a block, about.
BLOCK_CHARS = 16 << 20
#: Rows of a batch that are turned into tuples at once.
TUPLES = 512
#: Blocks whose answers lie in one folder.
SHELF = 8


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where all runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root or os.path.join(tempfile.gettempdir(), "webloam-llm")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, and lets later readers take only the columns they need."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_running(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """df with ``position`` (long, from 0 in the order) and ``<c>_before`` (long, what c sums to over all earlier rows).

    Rows are dealt by range and settled, so the whole order never meets in one task: totals of partitions (a row for
    each partition) are summed in a window of their own, running totals of rows inside their partition.
    Equal rows follow each other in any order. NULLs of ``sums`` count as 0.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    whole = [F.count(F.lit(1)).alias("_rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"_sum_{c}") for c in sums]]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    parts = dealt.groupBy("_part").agg(*whole).select(
        "_part", zero("_rows").alias("_rows0"), *[zero(f"_sum_{c}").alias(f"_sum0_{c}") for c in sums])
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: F.coalesce(F.sum(c).over(here), F.lit(0))
    return (
        dealt.withColumn("_row", inside(F.lit(1))).withColumns({f"_sum1_{c}": inside(c) for c in sums}).join(parts, "_part")
        .select(*df.columns, (F.col("_rows0") + F.col("_row")).cast("long").alias("position"),
                *[(F.col(f"_sum0_{c}") + F.col(f"_sum1_{c}")).cast("long").alias(f"{c}_before") for c in sums])
    )


def blocks(rows: Iterator, size_of) -> Iterator:
    """(block, rows): whole rows of a partition, about BLOCK_CHARS characters together. rows: tuples that begin with an id.

    A block's number follows from the ids and lengths of its rows, so passes over the same partitions agree on it.
    """
    import xxhash

    def number(held):
        return xxhash.xxh64_intdigest(repr([(r[0], size_of(r)) for r in held])) >> 1

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= BLOCK_CHARS:
            yield number(held), held
            held, size = [], 0
    if held:
        yield number(held), held


def tuples(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, TUPLES):  # few at once: texts stand twice while they are both Arrow's and Python's
            yield from zip(*[c.to_pylist() for c in batch.slice(at, TUPLES).columns])


def put_by_block(rows: DataFrame, shelves: int, name: str) -> str:
    """Write rows (with a column block) so that a task finds those of its block by reading part of one folder."""
    path = fresh_path(rows.sparkSession, name)
    # small row groups, in the order of blocks: a task reads little but its own
    rows.withColumn("shelf", F.pmod("block", F.lit(shelves))).repartition("shelf").sortWithinPartitions("shelf", "block") \
        .write.option("parquet.block.size", 4 << 20).partitionBy("shelf").parquet(path)
    return path


def of_block(path: str, shelves: int, block: int, columns: list[str]):
    """The rows of a block, as an Arrow table; none where the block has none. Row groups are read one after the other: all at once, they
    and what is read ahead would take far more memory than the block's rows."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/shelf={block % shelves}"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    found = ds.dataset(folder, filesystem=system, format="parquet").to_table(
        columns=columns, filter=ds.field("block") == block, use_threads=False, batch_readahead=1, fragment_readahead=1)
    pa.default_memory_pool().release_unused()
    return found


def block_of(texts: DataFrame) -> DataFrame:
    """``id`` and ``block`` of rows (id, text, ...); only ids and lengths of texts leave the scan."""
    kind, id_type = dict(texts.dtypes)["id"], to_arrow_type(texts.schema["id"].dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block, held in blocks(tuples(batches), lambda r: r[1]):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], id_type), pa.array([block] * len(held), pa.int64())], ["id", "block"])

    return texts.select("id", F.length("text").cast("long").alias("n")).mapInArrow(run, f"id {kind}, block long")


def map_blocks(docs: DataFrame, id_col: str, text_col: str, path: str, shelves: int, columns: list[str], work, schema) -> DataFrame:
    """``work(rows, ids, found)`` over all rows of docs, some at a time: rows and result are Arrow batches, ids the rows' ids, and found
    what ``put_by_block`` put at ``path`` for the rows' block (NULL where nothing). Blocks are those of ``block_of``."""
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        def rows():
            for batch in batches:
                sizes = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()
                for k, (i, n) in enumerate(zip(batch.column(id_at).to_pylist(), sizes)):
                    yield i, n, batch, k

        for block, held in blocks(rows(), lambda r: r[1]):
            found, at = of_block(path, shelves, block, columns), 0
            while at < len(held):  # the block's rows of one batch follow each other
                batch, first, to = held[at][2], held[at][3], at
                while to < len(held) and held[to][2] is batch:
                    to += 1
                out = work(batch.slice(first, to - at), [r[0] for r in held[at:to]], found)
                if out.num_rows:
                    yield out
                at = to

    return docs.mapInArrow(run, schema)


def shelves_for(placed: DataFrame) -> int:
    return max(1, placed.agg(F.count_distinct("block")).first()[0] // SHELF)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs but those whose id is in ``gone`` (its column ``id_col``), with the same columns. A NULL id is never in it.

    An anti join by id, so it does not matter how either side lies in partitions. Rows without an id are dealt by their text.
    """
    ids = gone.select(F.col(id_col).alias("_gone"), F.lit(0).cast("long").alias("_gone_salt")).dropna().distinct()
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    rows = docs.withColumn("_salt", salt)
    return rows.join(ids, (F.col(id_col) == F.col("_gone")) & (F.col("_salt") == F.col("_gone_salt")), "left_anti").select(*docs.columns)
