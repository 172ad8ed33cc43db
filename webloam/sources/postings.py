"""Postings on disk that grow by batches: each batch adds its own, removed logs are left out at read, and merges tidy up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloam.operators.search import build_postings
from webloam.sources.logs import _drop, _folders, days_of, parts_of

POSTINGS = "field string, term string, id string, positions array<int>, log_date date, batch_id long"
REMOVED = "id string, before long, batch_id long"
MERGED = "log_date date, upto long"
_ORDER = ("log_date", "field", "term")


def _write(rows: DataFrame, path: str) -> None:
    # by range, so that a term lies in few files, which the search finds by their bounds
    (rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch_id").parquet(path))


def _note_removed(ids: DataFrame, path: str, batch_id: int, before: int) -> None:
    (ids.select(F.col("id").cast("string").alias("id")).dropna().distinct().withColumn("before", F.lit(before).cast("long"))
     .write.mode("overwrite").parquet(f"{path}_removed/batch_id={batch_id}"))


def add_postings(logs: DataFrame, path: str, batch_id: int, replaces: bool = False) -> None:
    """Postings of log rows (with ``log_date``) as the batch ``batch_id``, a number from 0 that rises from batch to batch.

    Nothing else is read or rewritten. ``replaces``: rows may be new versions of logs that earlier batches hold; those count no more.
    The same batch again replaces itself.
    """
    if replaces:
        _note_removed(logs, path, batch_id, batch_id)
    _write(build_postings(logs).withColumn("batch_id", F.lit(batch_id).cast("long")), path)


def remove_postings(ids: DataFrame, path: str, batch_id: int) -> None:
    """Logs of these ids (column ``id``) are gone as of the batch, which must not hold postings of its own."""
    _note_removed(ids, path, batch_id, batch_id)


def follow_logs(path: str, replaces: bool = False):
    """A ``foreachBatch`` function that adds the postings of every batch of log rows."""
    return lambda batch, batch_id: add_postings(batch, path, batch_id, replaces)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """Postings that count with their ``batch_id``; merged ones have that of the last batch that was merged."""
    rows = spark.read.schema(POSTINGS).parquet(path)
    if _folders(f"{path}_merged", "upto"):
        upto = spark.read.schema(MERGED).parquet(f"{path}_merged").groupBy(F.col("log_date").alias("_day")).agg(F.max("upto").alias("_upto"))
        rows = rows.join(upto, F.col("log_date") == F.col("_day"), "left")
        live = F.when(F.col("_upto").isNull(), F.col("batch_id") >= 0).otherwise(
            (F.col("batch_id") > F.col("_upto")) | (F.col("batch_id") == -1 - F.col("_upto")))
        rows = rows.filter(live).withColumn("batch_id", F.greatest("batch_id", F.coalesce("_upto", F.lit(0)))).drop("_day", "_upto")
    else:
        rows = rows.filter("batch_id >= 0")
    if _folders(f"{path}_removed", "batch_id"):
        gone = spark.read.schema(REMOVED).parquet(f"{path}_removed").groupBy(F.col("id").alias("_gone")).agg(F.max("before").alias("_before"))
        rows = rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("batch_id") < F.col("_before")), "left_anti")
    return rows


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(field, term, id, positions, log_date), equal to postings built anew from all logs that are left."""
    return _batches(spark, path).drop("batch_id")


def merge_postings(spark: SparkSession, path: str) -> int:
    """Make one batch, in the order of terms, of each day that has several or holds postings of removed logs. Days that were merged.

    Merged postings are written where no reader sees them yet; a note then puts them in the place of the day's batches; these, and the
    ids of removed logs, are deleted last. A run that breaks on the way leaves the table as it reads, and the next one finishes it.
    """
    parts = parts_of(spark, path)
    batches = {}
    for day, batch in parts:
        batches.setdefault(day, []).append(batch)
    last = max([b for _, b in parts if b >= 0] + [int(v) for v in _folders(f"{path}_removed", "batch_id").values()], default=-1)
    days = {day for day, own in batches.items() if len(own) > 1}
    if _folders(f"{path}_removed", "batch_id"):
        rest = [day for day in batches if day not in days]
        gone = spark.read.schema(REMOVED).parquet(f"{path}_removed").select("id").distinct()
        # days of several batches are merged anyway: only the others are looked through
        found = spark.read.schema(POSTINGS).parquet(path).filter(F.col("log_date").isin(*rest)).join(gone, "id", "left_semi") if rest else None
        days |= {r["log_date"] for r in found.select("log_date").distinct().collect()} if rest else set()
    if last >= 0 and days:
        rows = _batches(spark, path).filter(F.col("log_date").isin(*days))
        stage = f"{path}_stage"
        _drop(stage)
        rows.drop("batch_id").write.parquet(stage)
        _write(spark.read.schema(POSTINGS).parquet(stage).withColumn("batch_id", F.lit(-1 - last).cast("long")), path)
        spark.createDataFrame([(day, last) for day in days], MERGED).coalesce(1).write.mode("overwrite").parquet(f"{path}_merged/upto={last}")
        _drop(stage)
        for day in days:
            for batch in batches[day]:
                if batch != -1 - last:
                    _drop(f"{path}/log_date={day.isoformat()}/batch_id={batch}")
    for folder, batch in _folders(f"{path}_removed", "batch_id").items():
        if int(batch) <= last:
            _drop(f"{path}_removed/{folder}")
    return len(days)


def postings_parts(spark: SparkSession, path: str) -> dict:
    """Batches on disk by day."""
    return {day: sorted(b for d, b in parts_of(spark, path) if d == day) for day in days_of(spark, path)}
