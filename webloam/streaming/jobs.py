"""Streaming jobs: arriving pages to log rows, log rows to daily statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from webloam.plans.batch import run_batch, to_log_row
from webloam.schemas import PAGES, PipelineConfig, utc_day
from webloam.sources.logs import read_log_files, write_batch


# X1
def stream_pages_to_logs(spark: SparkSession, source: str, out: str, checkpoint: str,
                         config: PipelineConfig = PipelineConfig(), also=None) -> StreamingQuery:
    """Run every newly arrived page file through the chain and write its log rows.

    Each micro-batch owns its partitions of the log table and replaces them when it is run again, so a restart writes nothing
    twice. ``also`` gets the written rows and the batch id, for example to maintain postings.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(to_log_row(run_batch(batch, config=config)), out, batch_id)
        if also is not None:
            also(read_log_files(spark, out).filter(F.col("batch_id") == batch_id), batch_id)

    return (
        spark.readStream.schema(PAGES).parquet(source)
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# X2
def stream_daily_stats(logs: DataFrame, out: str, checkpoint: str, open_for: str = "30 days") -> StreamingQuery:
    """Count a stream of logs by UTC day, with state; ``read_daily_stats`` has all days seen so far, open ones included.

    A day's totals stay in the state until the newest time seen is ``open_for`` beyond its end, so the state holds that many days at
    most. Each micro-batch gives the totals of the days it changed, and each day has a folder of its own that is replaced: the
    result is a row for each day, and a batch that runs again writes the same. Rows of a closed day are not counted here
    (the query's progress tells how many); ``recount_days`` counts such days anew from the log table. Rows without a time are of no day.
    """
    days = logs.withWatermark("timestamp", open_for).groupBy(F.window("timestamp", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.coalesce(F.col("status") == "success", F.lit(False))).alias("success"))

    def write(batch: DataFrame, batch_id: int) -> None:
        _put_days(batch.withColumn("date", utc_day(F.col("day.start"))), out)

    return (days.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _put_days(days: DataFrame, out: str) -> None:
    (days.select("count", "success", "date").repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(out))


def recount_days(logs: DataFrame, out: str, days: list[date]) -> None:
    """Totals of these days out of the log table, in the place of the stream's. For closed days that got rows later."""
    day = utc_day(F.col("timestamp"))
    rows = logs.filter(day.isin(*days))
    rows = rows.filter(F.col("log_date").isin(*days)) if "log_date" in logs.columns else rows
    _put_days(rows.groupBy(day.alias("date")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.coalesce(F.col("status") == "success", F.lit(False))).alias("success")), out)


def read_daily_stats(spark: SparkSession, out: str) -> DataFrame:
    """(date, count, success) of all days."""
    return spark.read.schema("count long, success long, date date").parquet(out).select("date", "count", "success")
