"""The log table on disk (Parquet by day), its exports and its row removal."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloam.functions.text import from_json_field, let, url_path
from webloam.operators.audit import count_logs, delete_log, filter_logs, newest_rows
from webloam.schemas import JSON_FIELDS, LOG, RETENTION_DAYS, LogFilters, utc_date, utc_day
from webloam.sources.pages import conform

# On disk the JSON columns are text. Partitions are days, and in a day the batch that wrote the rows.
LOG_FILES = T.StructType([
    T.StructField(f.name, T.StringType() if f.name in JSON_FIELDS else f.dataType) for f in LOG
] + [T.StructField("log_date", T.DateType()), T.StructField("batch_id", T.LongType())])
PARTS = ("log_date", "batch_id")
#: The batch of rows that ``append_logs`` writes.
APPENDED = -1


def serialize_json(df: DataFrame) -> DataFrame:
    """JSON columns as text; other columns untouched. Text columns pass through."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: F.to_json(c) for c in JSON_FIELDS if c in kinds and kinds[c] != "string"})


def prepare_logs(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """Rows ready for the table: an id each, a time where missing, JSON text, the day."""
    full = conform(serialize_json(df), T.StructType(LOG_FILES.fields[:-2]))
    moment = F.date_trunc("second", F.current_timestamp()) if now is None else F.lit(now)
    return (
        full.withColumn("id", F.coalesce("id", F.uuid()))
        .withColumn("timestamp", F.coalesce(F.col("timestamp"), moment))
        .withColumn("log_date", utc_day(F.col("timestamp")))
    )


#: How files of the log table are packed: texts take about half of what Spark's default leaves.
CODEC = "zstd"
#: Sizes that a bloom filter of ids may have: from 1 MB, halved each time, to 512 bytes. A file keeps the least one that suits its ids.
_SIZES = 12


def written(rows: DataFrame, mode: str):
    """A writer of table rows. Files are in the order of time, and carry a bloom filter of ids, so that a scan for an id or for a
    range of time skips row groups. A dictionary of ids would take the filter's place and is left out. Texts are most of a table,
    and are packed by ``CODEC``."""
    return (rows.sortWithinPartitions(*PARTS, "timestamp").write.mode(mode).partitionBy(*PARTS).option("compression", CODEC)
            .option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.bloom.filter.candidates.number#id", str(_SIZES)).option("parquet.bloom.filter.fpp#id", "0.001")
            .option("parquet.enable.dictionary#id", "false"))


#: Rows of a file, on average, from which rows are written where they are. With texts some 1 MB.
FILE_ROWS = 500


def by_day(rows: DataFrame) -> DataFrame:
    """Rows as they go to ``written``: rebalanced by day, so that a day has few files and a hot one is split, or as they are where files
    hold enough rows without that and tasks share the work well.

    An exchange of whole rows takes about as much disk as the table itself. So rows are first counted by task and partition; no texts
    are read for that. Where so few columns are read, Spark may merge more of its shuffle partitions than it does for whole rows, so
    tasks count as no fewer than these.
    """
    spark = rows.sparkSession
    tasks = (rows.select(F.spark_partition_id().alias("task"), *PARTS).groupBy("task", *PARTS).agg(F.count(F.lit(1)).alias("n"))
             .groupBy("task").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files")))
    total, most, files, n = tasks.agg(F.sum("n"), F.max("n"), F.sum("files"), F.count(F.lit(1))).first()
    if n:
        files *= max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) / n)
        if total >= FILE_ROWS * files and most * spark.sparkContext.defaultParallelism <= 2 * total:
            return rows
    return rows.hint("rebalance", "log_date")


# S3
def append_logs(df: DataFrame, path: str, now: datetime | None = None) -> None:
    """Rows go to their days, by way of an exchange only where files would be small without it (``by_day``)."""
    rows = prepare_logs(df, now).withColumn("batch_id", F.lit(APPENDED).cast("long"))
    written(by_day(rows), "append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, now: datetime | None = None) -> None:
    """Rows of a micro-batch. Running it again replaces what it wrote before, on whatever day, and gives rows the same ids.

    A row without an id gets one from the batch and all its values. The days of a batch are kept beside the table, in a folder for
    each batch, and are written before its rows: a run that follows a broken one knows what to replace and lists no other days.
    """
    spark = df.sparkSession
    values = F.to_json(F.struct(*[c for c in df.columns if c not in ("id", "timestamp")]))
    made = F.md5(F.concat_ws("|", F.lit(batch_id).cast("string"), values))
    own = F.coalesce(F.col("id"), made) if "id" in df.columns else made
    rows = prepare_logs(df.withColumn("id", own), now).withColumn("batch_id", F.lit(batch_id).cast("long"))
    days = f"{path}_days/batch_id={batch_id}"
    before = [date.fromisoformat(v) for v in _folders(days, "log_date").values()]

    def note(filled: set) -> None:
        for day, _ in filled:
            _make(f"{days}/log_date={day.isoformat()}")

    replace_parts(rows.hint("rebalance", "log_date"), path, [(day, batch_id) for day in before], note)


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_FILES).parquet(path)


# S4
def decode_json(logs: DataFrame) -> DataFrame:
    """JSON columns parsed into ``<name>_value``; the text stays beside, which keeps bad JSON readable."""
    return logs.withColumns({f"{c}_value": from_json_field(F.col(c), ddl) for c, ddl in JSON_FIELDS.items()})


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return decode_json(read_log_files(spark, path))


# The column names of the CSV export.
CSV_COLUMNS = {
    "id": "ID", "url": "URL", "timestamp": "Timestamp", "status": "Status", "content_type": "Content Type",
    "duration_ms": "Duration (ms)", "content_length": "Content Length", "http_status_code": "HTTP Status",
    "error_message": "Error", "links_count": "Links", "images_count": "Images",
}


# S5
def csv_rows(logs: DataFrame, filters: LogFilters | None = None, cap: int | None = None) -> DataFrame:
    """The 11 export columns of all matches, newest first; of the newest ``cap`` where the caller gives one."""
    narrow = filter_logs(logs, filters).select(*CSV_COLUMNS)
    top = narrow.orderBy(F.desc("timestamp"), F.desc("id"))
    top = top if cap is None else top.limit(cap)
    return top.select(*[F.col(c).alias(name) for c, name in CSV_COLUMNS.items()])


def export_csv(logs: DataFrame, path: str, filters: LogFilters | None = None, cap: int | None = None) -> None:
    """CSV files with a header each, NULL as empty; file after file in the order of the rows."""
    (csv_rows(logs, filters, cap).write.mode("overwrite").option("header", True)
     .option("emptyValue", "").option("nullValue", "").csv(path))


# S6
def json_rows(logs: DataFrame, filters: LogFilters | None = None, include_content: bool = False,
              cap: int | None = None) -> DataFrame:
    """All matches, newest first, or the newest ``cap``, without the content unless asked for (then it is never read)."""
    return newest_rows(logs if include_content else logs.drop("markdown_content"), filters, cap)


def json_manifest(logs: DataFrame, filters: LogFilters | None, exported_at: datetime) -> DataFrame:
    """One row: exported_at, total_records of all matches, and the filters."""
    f = filters or LogFilters()
    return count_logs(logs, filters).select(
        F.lit(exported_at.isoformat()).alias("exported_at"), F.col("total").alias("total_records"),
        F.struct(*[F.lit(getattr(f, k)).cast("string").alias(k) for k in ("status", "content_type", "url_search")])
        .alias("filters"))


def export_json(logs: DataFrame, path: str, exported_at: datetime, filters: LogFilters | None = None,
                include_content: bool = False, cap: int | None = None) -> None:
    """``<path>/manifest`` and ``<path>/logs``, JSON lines."""
    json_manifest(logs, filters, exported_at).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    json_rows(logs, filters, include_content, cap).write.mode("overwrite").json(f"{path}/logs")


# S7
def format_markdown_report(results: DataFrame, *keep: str) -> DataFrame:
    """(name, report) per document, behind the columns to keep: the Markdown file and what it is called."""
    def name(path: Column) -> Column:
        return F.when(path == "", F.lit("index")).otherwise(F.translate(path, "/", "_"))

    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = url_path(F.col("url"))
    steps = F.when(F.size("steps_applied") > 0, F.concat(
        F.lit("> Pipeline: "), F.array_join("steps_applied", ", "), F.lit("\n"))).otherwise(F.lit(""))
    report = F.concat(
        F.lit("# Scrape de "), host, path, F.lit("\n\n> URL: "), F.col("url"),
        F.lit("\n> Titre: "), F.coalesce(F.when(F.length("title") > 0, F.col("title")), F.lit("N/A")),
        F.lit("\n> Longueur: "), F.length("markdown").cast("string"), F.lit(" caractères\n> Type: "),
        F.col("content_type"), F.lit("\n"), steps, F.lit("\n---\n\n"), F.col("markdown"))
    return results.select(*keep, F.concat(host, F.lit("_"), let(F.btrim(path, F.lit("/")), name), F.lit(".md")).alias("name"),
                          report.alias("report"))


def write_markdown_reports(results: DataFrame, path: str) -> None:
    """Reports as rows (url, name, report) in the order of names, so that one is found by the bounds of files.

    Documents of one name, such as pages that differ in their query string only, are told apart by their URL.
    """
    (format_markdown_report(results, "url").repartitionByRange("name").sortWithinPartitions("name")
     .write.mode("overwrite").parquet(path))


def _store(path: str):
    """The file system that holds the path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _folders(path: str, column: str) -> dict[str, str]:
    """Values of a partition column that have a folder below the path, by folder (a listing)."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {x.base_name: x.base_name.split("=", 1)[1] for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{column}=")}


def _drop(path: str) -> bool:
    from pyarrow import fs

    store, root = _store(path)
    if store.get_file_info(root).type == fs.FileType.NotFound:
        return False
    store.delete_dir(root)
    return True


def _make(path: str) -> None:
    store, root = _store(path)
    store.create_dir(root, recursive=True)


def drop_day(spark: SparkSession, path: str, day: date) -> bool:
    """Remove the whole partition of a day; false when there was none."""
    return _drop(f"{path}/log_date={day.isoformat()}")


def days_of(spark: SparkSession, path: str) -> list[date]:
    """Days that have a partition (one entry per calendar day)."""
    return sorted(date.fromisoformat(v) for v in _folders(path, "log_date").values() if v[:1].isdigit())


def parts_of(spark: SparkSession, path: str) -> list[tuple[date, int]]:
    """(day, batch) of all partitions."""
    return [(day, int(b)) for day in days_of(spark, path) for b in _folders(f"{path}/log_date={day.isoformat()}", "batch_id").values()]


def replace_parts(rows: DataFrame, path: str, parts: list[tuple[date, int]], note=lambda filled: None) -> None:
    """Put ``rows`` in the place of those partitions, each swapped by Spark's own partition overwrite; those left empty are removed.

    The order: rows, which may be read from the table itself, are staged beside it; ``note`` is told which partitions they fill; these
    are overwritten; partitions left empty are removed, one by one. A run that breaks before the overwrite changes nothing, one that
    breaks later leaves old rows only in partitions that were to be removed; the same call again finishes it.
    """
    spark = rows.sparkSession
    stage = f"{path}_stage_{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", CODEC).partitionBy(*PARTS).parquet(stage)
        filled = set(parts_of(spark, stage))
        note(filled)
        if filled:
            (written(spark.read.schema(LOG_FILES).parquet(stage).hint("rebalance", "log_date"), "overwrite")
             .option("partitionOverwriteMode", "dynamic").parquet(path))
        for day, batch in parts:
            if (day, batch) not in filled:
                _drop(f"{path}/log_date={day.isoformat()}/batch_id={batch}")
    finally:
        _drop(stage)


def delete_log_at(spark: SparkSession, path: str, log_id: str) -> bool:
    """M1 on disk: only the partitions that hold the log are rewritten. True if it was there; after a broken run, again."""
    logs = read_log_files(spark, path)
    parts = [tuple(r) for r in logs.filter(F.col("id") == log_id).select(*PARTS).distinct().collect()]
    if parts:
        here = reduce(lambda a, b: a | b, [(F.col("log_date") == F.lit(day)) & (F.col("batch_id") == batch) for day, batch in parts])
        replace_parts(delete_log(logs.filter(here), log_id)[0], path, parts)
    return bool(parts)


def delete_old_logs_at(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> int:
    """M2 and M3 on disk: the day of the cutoff is rewritten, then older days go whole. Rows that went.

    The count is of rows that were to go. A run that breaks reports none, and the next one counts and removes what is left.
    """
    cutoff = as_of - timedelta(days=days)
    last = utc_date(cutoff)
    logs = read_log_files(spark, path)
    old = logs.filter((F.col("log_date") <= F.lit(last)) & (F.col("timestamp") < F.lit(cutoff)))
    removed = old.count()
    split = [p for p in parts_of(spark, path) if p[0] == last]
    if split and removed:
        replace_parts(logs.filter((F.col("log_date") == F.lit(last)) & (F.col("timestamp") >= F.lit(cutoff))), path, split)
    for day in days_of(spark, path):
        if day < last:
            drop_day(spark, path, day)
    return removed


def clear_logs_at(spark: SparkSession, path: str) -> int:
    """M4 on disk. Rows that went."""
    removed = read_log_files(spark, path).count()
    for folder in _folders(path, "log_date"):
        _drop(f"{path}/{folder}")
    return removed
