"""Explicit table schemas and the frozen settings objects the operators take."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SSL_INFO = T.StructType([
    T.StructField("valid", T.BooleanType()),
    T.StructField("issuer", T.StringType()),
    T.StructField("expires", T.StringType()),
])
HEADERS = T.MapType(T.StringType(), T.StringType())

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("fallback_markdown", T.StringType()),
    T.StructField("page_title", T.StringType()),
    T.StructField("og_title", T.StringType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("redirected_url", T.StringType()),
    T.StructField("response_headers", HEADERS),
    T.StructField("ssl_info", SSL_INFO),
    T.StructField("fetch_error", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
])

PDF_META = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("title", "author", "subject", "creator", "producer", "creationDate", "modDate")
])

PDF_PAGES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("meta", PDF_META),
    T.StructField("fetch_error", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
])

RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("links_count", T.IntegerType()),
    T.StructField("images_count", T.IntegerType()),
    T.StructField("js_executed", T.BooleanType()),
    T.StructField("redirected_url", T.StringType()),
    T.StructField("response_headers", HEADERS),
    T.StructField("ssl_info", SSL_INFO),
    T.StructField("redirects", T.ArrayType(T.StringType())),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("pdf_title", T.StringType()),
    T.StructField("pdf_author", T.StringType()),
    T.StructField("pdf_pages", T.IntegerType()),
    T.StructField("pdf_creation_date", T.StringType()),
    T.StructField("pipeline_steps", T.ArrayType(T.StringType())),
    T.StructField("extracted_title", T.StringType()),
])

LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("content_length", T.LongType()),
    T.StructField("markdown_content", T.StringType()),
    T.StructField("response_headers", HEADERS),
    T.StructField("js_executed", T.BooleanType()),
    T.StructField("redirects", T.ArrayType(T.StringType())),
    T.StructField("ssl_info", SSL_INFO),
    T.StructField("links_count", T.IntegerType()),
    T.StructField("images_count", T.IntegerType()),
    T.StructField("pdf_title", T.StringType()),
    T.StructField("pdf_author", T.StringType()),
    T.StructField("pdf_pages", T.IntegerType()),
    T.StructField("pdf_creation_date", T.StringType()),
])

# The three JSON columns, as DDL strings for from_json.
JSON_FIELDS = {
    "response_headers": "map<string,string>",
    "redirects": "array<string>",
    "ssl_info": "struct<valid:boolean,issuer:string,expires:string>",
}

# The allowed states of a log row, the numeric limits.
STATUSES = ("success", "error", "timeout")
CONTENT_TYPES = ("html", "pdf", "spa")
TIMEOUT_MIN_MS, TIMEOUT_DEFAULT_MS, TIMEOUT_MAX_MS = 1_000, 30_000, 120_000
PER_PAGE_MIN, PER_PAGE_DEFAULT, PER_PAGE_MAX = 10, 20, 100
RETENTION_DAYS = 30
MAX_ATTEMPTS = 3


@dataclass(frozen=True)
class PipelineConfig:
    """Switches and thresholds of the page chain."""

    prune: bool = True
    extract: bool = True
    regex_clean: bool = True
    include_images: bool = True
    strict_clean: bool = False
    strip_residue: bool = False
    min_ratio: float = 0.3
    min_words: int = 10
    max_loss: float = 10.0
    min_answer_chars: int = 100
    min_section_chars: int = 50
    max_pdf_mb: int | None = None


def utc_day(timestamp: Column) -> Column:
    """The UTC day of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(timestamp) / 86_400_000_000).cast("int"))


def utc_date(moment: datetime) -> date:
    """The UTC day of a moment; one without a time zone is local, as Spark takes it."""
    return moment.astimezone(timezone.utc).date()


def like_anywhere(column: Column, needle: str) -> Column:
    """Case-blind ``LIKE %needle%``; ``%`` and ``_`` in the needle stay wildcards.

    Unlike an ASCII-only LIKE, accented letters are folded too.
    """
    return column.ilike("%" + needle.replace("\\", "\\\\") + "%")


@dataclass(frozen=True)
class LogFilters:
    """The optional log filters; ``predicate`` is the AND of those that are set."""

    status: str | None = None
    content_type: str | None = None
    url_search: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    #: A further condition, such as a search (``search.match(terms)``): paging, counting and exports then go by it too.
    matching: Column | None = None

    def predicate(self) -> Column:
        parts = []
        if self.status:
            parts.append(F.col("status") == self.status)
        if self.content_type:
            parts.append(F.col("content_type") == self.content_type)
        if self.url_search:
            parts.append(like_anywhere(F.col("url"), self.url_search))
        if self.date_from:
            parts.append(F.col("timestamp") >= F.lit(self.date_from))
        if self.date_to:
            parts.append(F.col("timestamp") <= F.lit(self.date_to))
        if self.matching is not None:
            parts.append(self.matching)
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def day_predicate(self, day: str = "log_date") -> Column:
        """The date bounds restated on the partition column, so that whole days are pruned."""
        parts = []
        if self.date_from:
            parts.append(F.col(day) >= F.lit(utc_date(self.date_from)))
        if self.date_to:
            parts.append(F.col(day) <= F.lit(utc_date(self.date_to)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))
