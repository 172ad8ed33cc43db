"""Audit-log operators: lookups, statistics, paging, validation, retention.

Every "now" is an argument. Statistics aggregate partially before the exchange; pages
of rows are top-k, never a full sort.
"""

from __future__ import annotations

import base64
import binascii
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloam.schemas import (
    CONTENT_TYPES, PER_PAGE_DEFAULT, PER_PAGE_MAX, PER_PAGE_MIN, RETENTION_DAYS, STATUSES,
    TIMEOUT_DEFAULT_MS, TIMEOUT_MAX_MS, TIMEOUT_MIN_MS, LogFilters, utc_date, utc_day,
)

SUMMARY = ("id", "url", "timestamp", "duration_ms", "status", "content_type", "content_length", "http_status_code")


def filter_logs(logs: DataFrame, filters: LogFilters | None) -> DataFrame:
    """Rows that satisfy the filters; date bounds also prune day partitions when there are any."""
    if filters is None:
        return logs
    out = logs.filter(filters.predicate())
    return out.filter(filters.day_predicate()) if "log_date" in logs.columns else out


# F1
def get_log(logs: DataFrame, log_id: str) -> DataFrame:
    """The row of an id. In the table's files a bloom filter tells the scan which row groups cannot hold it."""
    return logs.filter(F.col("id") == log_id)


# F8
def summarize(logs: DataFrame) -> DataFrame:
    return logs.select(*SUMMARY)


# F9
def log_faults() -> Column:
    """Reasons why a row is no valid log row; empty for a valid one."""
    def fault(bad: Column, reason: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(reason))

    return F.array_compact(F.array(
        fault(F.col("url").isNull(), "url missing"),
        fault(~F.col("status").isin(*STATUSES), "status not allowed"),
        fault(~F.col("content_type").isin(*CONTENT_TYPES), "content_type not allowed"),
        fault(F.col("duration_ms") < 0, "duration_ms missing or negative"),
    ))


def validate_logs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows carry ``reasons``."""
    marked = df.withColumn("reasons", log_faults())
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


# F10
def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) fetch requests; a missing timeout becomes the default."""
    fixed = df.withColumn("timeout", F.coalesce(F.col("timeout"), F.lit(TIMEOUT_DEFAULT_MS)))
    good_url = F.coalesce(F.col("url").rlike(r"^(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?$"), F.lit(False))
    good_timeout = F.col("timeout").between(TIMEOUT_MIN_MS, TIMEOUT_MAX_MS)
    marked = fixed.withColumn("reasons", F.array_compact(F.array(
        F.when(~good_url, F.lit("url malformed")), F.when(~good_timeout, F.lit("timeout out of range")))))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def _count_of(column: str, value: str) -> Column:
    return F.count_if(F.coalesce(F.col(column) == value, F.lit(False)))


# G3
def success_rate(success: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(success / total * 100, 1)).otherwise(F.lit(0.0))


# G1
def log_stats(logs: DataFrame) -> DataFrame:
    """One row of global statistics. Sums are 0 on an empty log, the average stays NULL."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_scrapes"),
        *[_count_of("status", s).alias(f"{s}_count") for s in STATUSES],
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.coalesce(F.sum("content_length"), F.lit(0)).alias("total_content_length"),
        *[_count_of("content_type", t).alias(f"{t}_count") for t in CONTENT_TYPES],
    )


# G2
def daily_stats(logs: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """(date, count, success) of the last days, ascending; days without rows are absent."""
    recent = filter_logs(logs, LogFilters(date_from=as_of - timedelta(days=days)))
    return (
        recent.groupBy(utc_day(F.col("timestamp")).alias("date"))
        .agg(F.count(F.lit(1)).alias("count"), _count_of("status", "success").alias("success"))
        .orderBy("date")
    )


# G4
def count_logs(logs: DataFrame, filters: LogFilters | None = None) -> DataFrame:
    return filter_logs(logs, filters).agg(F.count(F.lit(1)).alias("total"))


# G5
def full_stats(logs: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Global and daily statistics in one row, from one scan.

    Rows are first grouped by their recent day (NULL for older rows), which leaves at
    most ``days`` + 2 partial rows for the second step.
    """
    cutoff = F.lit(as_of - timedelta(days=days))
    day = F.when(F.col("timestamp") >= cutoff, utc_day(F.col("timestamp")))
    sums = [f"{s}_count" for s in STATUSES] + [f"{t}_count" for t in CONTENT_TYPES]
    parts = logs.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        *[_count_of("status", s).alias(f"{s}_count") for s in STATUSES],
        *[_count_of("content_type", t).alias(f"{t}_count") for t in CONTENT_TYPES],
        F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("timed"),
        F.sum("content_length").alias("chars"),
    )
    one_day = F.struct(F.col("day").alias("date"), F.col("n").alias("count"), F.col("success_count").alias("success"))
    whole = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_scrapes"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.when(F.sum("timed") > 0, F.sum("ms") / F.sum("timed")).alias("avg_duration_ms"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("total_content_length"),
        F.sort_array(F.collect_list(F.when(F.col("day").isNotNull(), one_day))).alias("daily_stats"),
    )
    return whole.withColumn("success_rate", success_rate(F.col("success_count"), F.col("total_scrapes")))


def _newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("id").desc()]


#: Rows before a page that one task may sort and skip.
NEAR = 10_000
#: Widths of time ranges in microseconds, each a part of the one before.
_RANGES = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def _jump(rows: DataFrame, skip: int, limit: int, near: int) -> tuple[DataFrame, int]:
    """The rows of the time ranges that hold a far page, and how many of them come before it.

    Rows are counted by day; only the days that hold the page are counted by hour, and so on. What reaches the driver are
    counts of ranges: one for each day, then of the parts of one or two ranges at a time. Rows without a time come last.
    """
    time = F.unix_micros("timestamp")
    for width in _RANGES:
        if skip <= near:
            break
        found = rows.groupBy(F.floor(time / width).cast("long").alias("r")).count().collect()
        ranges = sorted(((r["r"], r["count"]) for r in found), key=lambda r: (r[0] is None, -(r[0] or 0)))
        ahead, held, top, low = 0, 0, None, None
        for r, n in ranges:
            if top is None and ahead + n <= skip and (r, n) != ranges[-1]:
                ahead += n  # the whole range is newer than the page
                continue
            top = top if top is not None else (r,)
            held, low = held + n, r
            if ahead + held >= skip + limit:
                break
        if top is None:
            break
        skip -= ahead
        if top[0] is None:
            return rows.filter(F.col("timestamp").isNull()), skip
        newest = time < (top[0] + 1) * width
        inside = (newest & (time >= low * width)) if low is not None else newest | F.col("timestamp").isNull()
        rows = rows.filter(inside)
        if "log_date" in rows.columns and low is not None:
            day = lambda r: F.date_from_unix_date(F.lit(r * width // 86_400_000_000).cast("int"))
            rows = rows.filter(F.col("log_date").between(day(low), day(top[0])))
    return rows, skip


# T1
def page_logs(logs: DataFrame, page: int = 1, per_page: int = PER_PAGE_DEFAULT,
              filters: LogFilters | None = None, near: int = NEAR) -> DataFrame:
    """One page of summaries, newest first.

    A page behind more than ``near`` rows is reached by counts of time ranges, so that no task sorts what comes before it; only
    rows of one and the same instant are skipped one by one.
    """
    if page < 1 or not PER_PAGE_MIN <= per_page <= PER_PAGE_MAX:
        raise ValueError(f"page must be >= 1 and per_page within {PER_PAGE_MIN}..{PER_PAGE_MAX}")
    rows, skip = filter_logs(logs, filters), (page - 1) * per_page
    if skip > near:
        rows, skip = _jump(rows, skip, per_page, near)
    return summarize(rows).orderBy(*_newest_first()).offset(skip).limit(per_page)


def page_meta(logs: DataFrame, page: int = 1, per_page: int = PER_PAGE_DEFAULT,
              filters: LogFilters | None = None) -> DataFrame:
    """One row: total, page, per_page, total_pages (1 when there are no rows)."""
    return count_logs(logs, filters).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)).cast("long").alias("total_pages"))


# T3
def encode_cursor(timestamp: Column, log_id: Column) -> Column:
    """Base64 of ``microseconds|id``."""
    return F.base64(F.encode(F.concat(F.unix_micros(timestamp).cast("string"), F.lit("|"), log_id), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    """struct(timestamp, id); NULL when the cursor is not one of ours."""
    text = F.try_to_binary(cursor, F.lit("base64")).cast("string")
    micros = F.substring_index(text, "|", 1).try_cast("long")
    return F.when(micros.isNotNull() & F.contains(text, F.lit("|")), F.struct(
        F.timestamp_micros(micros).alias("timestamp"), F.regexp_extract(text, r"(?s)^[^|]*\|(.*)$", 1).alias("id")))


def parse_cursor(cursor: str | None) -> tuple[datetime, str] | None:
    """The cursor as plain values, so that its bound reaches the scan; None when it is bad."""
    if not cursor:
        return None
    try:
        micros, bar, log_id = base64.b64decode(cursor).decode("utf-8").partition("|")
        if not bar:
            return None
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=int(micros)), log_id
    except (ValueError, OverflowError, binascii.Error):
        return None


# T2
def page_logs_keyset(logs: DataFrame, cursor: str | None = None, limit: int = 50,
                     status: str | None = None, content_type: str | None = None) -> DataFrame:
    """Summaries behind the cursor, newest first, each with ``has_more`` and ``next_cursor``.

    One row more than asked for is fetched to learn whether there are more. A bad cursor
    is ignored. The key is (timestamp, id); its bound on ``timestamp`` is pushed to the scan.
    ``limit`` is bounded as a page is, which also bounds the windows below.
    """
    if not PER_PAGE_MIN <= limit <= PER_PAGE_MAX:
        raise ValueError(f"limit must be within {PER_PAGE_MIN}..{PER_PAGE_MAX}")
    rows = filter_logs(logs, LogFilters(status=status, content_type=content_type))
    at = parse_cursor(cursor)
    if at is not None:
        moment, last_id = F.lit(at[0]), F.lit(at[1])
        rows = rows.filter((F.col("timestamp") <= moment)
                           & ((F.col("timestamp") < moment) | (F.col("id") < last_id)))
        if "log_date" in logs.columns:
            rows = rows.filter(F.col("log_date") <= F.lit(utc_date(at[0])))
    top = summarize(rows).orderBy(*_newest_first()).limit(limit + 1)
    # At most limit + 1 rows are left, so the windows over all of them are small.
    ranked = top.withColumn("_rn", F.row_number().over(Window.orderBy(*_newest_first())))
    key = F.when(F.col("_rn") == limit, encode_cursor(F.col("timestamp"), F.col("id")))
    everything = Window.partitionBy(F.lit(1))
    return (
        ranked.withColumn("has_more", F.max("_rn").over(everything) > limit)
        .withColumn("next_cursor", F.when(F.col("has_more"), F.max(key).over(everything)))
        .filter(F.col("_rn") <= limit).drop("_rn")
    )


# T4
def recent_logs(logs: DataFrame, n: int = 10) -> DataFrame:
    return summarize(logs).orderBy(*_newest_first()).limit(n)


# T5
def newest_rows(logs: DataFrame, filters: LogFilters | None = None, n: int | None = None) -> DataFrame:
    """Whole rows of all matches, newest first, or of the newest ``n``; rows without a time come last.

    For ``n`` the keys are found first, on narrow columns, and the wide rows are then fetched by a join with those keys, NULL
    keys included. Rows of equal keys at the end are cut to ``n``.
    """
    rows = filter_logs(logs, filters)
    if n is None:
        return rows.orderBy(*_newest_first())
    keys = [c for c in ("log_date", "timestamp", "id") if c in logs.columns]
    top = rows.select(*[F.col(c).alias(f"_{c}") for c in keys]).orderBy(F.desc("_timestamp"), F.desc("_id")).limit(n)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return rows.join(top, reduce(lambda a, b: a & b, same), "left_semi").orderBy(*_newest_first()).limit(n)


def _removed(logs: DataFrame, gone: Column) -> DataFrame:
    return logs.filter(gone).agg(F.count(F.lit(1)).alias("removed_count"))


# M1
def delete_log(logs: DataFrame, log_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row removed_count)."""
    gone = F.col("id") == log_id
    return logs.filter(~gone | F.col("id").isNull()), _removed(logs, gone)


# M3
def delete_old_logs(logs: DataFrame, as_of: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the last ``days`` days and rows without a time, one-row removed_count)."""
    cutoff = F.lit(as_of - timedelta(days=days))
    return (logs.filter((F.col("timestamp") >= cutoff) | F.col("timestamp").isNull()),
            _removed(logs, F.col("timestamp") < cutoff))


# M2
def cleanup_old_logs(logs: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    return delete_old_logs(logs, as_of, RETENTION_DAYS)


# M4
def clear_all_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return logs.limit(0), _removed(logs, F.lit(True))


# O2
def urls_to_refetch(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """URLs behind the chosen logs, for a new fetch run. ``ids`` has a column ``id``."""
    return logs.join(ids.select("id"), "id", "left_semi").select("url")
