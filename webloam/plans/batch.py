"""One result and one log row per requested URL, HTML and PDF together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloam.functions.outcome import classify_status, result_content_type
from webloam.functions.text import content_hash, content_length
from webloam.operators.pdf import pdf_results
from webloam.plans.documents import process_pages
from webloam.schemas import LOG, RESULT, PipelineConfig
from webloam.sources.pages import conform


# S8
def to_result(outcomes: DataFrame) -> DataFrame:
    """Result rows out of pipeline or PDF outcomes.

    Adds the hash, the kind of content, ``redirects`` and the PDF struct, which is set only
    for PDF results that have a title or pages.
    """
    df = conform(outcomes, RESULT)
    pdf = F.struct(F.col("pdf_title").alias("title"), F.col("pdf_author").alias("author"),
                   F.col("pdf_pages").alias("pages"), F.col("pdf_creation_date").alias("creation_date"))
    has_pdf = (F.col("content_type") == "pdf") & ((F.length("pdf_title") > 0) | (F.col("pdf_pages") > 0))
    filled = df.withColumns({
        "markdown": F.coalesce("markdown", F.lit("")),
        "content_type": F.coalesce("content_type", result_content_type(F.lit("html"), F.col("success"))),
        "duration_ms": F.coalesce("duration_ms", F.lit(0).cast("long")),
        "links_count": F.coalesce("links_count", F.lit(0)),
        "images_count": F.coalesce("images_count", F.lit(0)),
        "retry_count": F.coalesce("retry_count", F.lit(0)),
        "js_executed": F.coalesce("js_executed", F.lit(False)),
    })
    return filled.withColumns({
        "content_hash": content_hash(F.col("markdown"), F.col("success")),
        "content_length": content_length(F.col("markdown")),
        "redirects": F.when(F.length("redirected_url") > 0, F.array("redirected_url")),
        "pdf_metadata": F.when(F.coalesce(has_pdf, F.lit(False)), pdf),
    })


def to_log_row(results: DataFrame) -> DataFrame:
    """Log rows (without id and time, which the table gives) out of result rows."""
    logs = results.withColumns({
        "status": classify_status(F.col("success"), F.col("error")),
        "error_message": F.col("error"), "markdown_content": F.col("markdown")})
    return conform(logs, T.StructType([f for f in LOG if f.name not in ("id", "timestamp")]))


def page_outcomes(pages: DataFrame, config: PipelineConfig = PipelineConfig(),
                  responses: DataFrame | None = None) -> DataFrame:
    """Outcomes of the HTML branch; a page that carries ``fetch_error`` failed and yields no document."""
    extra = ["http_status_code", "redirected_url", "response_headers", "ssl_info", "fetch_error", "duration_ms"]
    present = [c for c in extra if c in pages.columns]
    df = pages
    if "fetch_error" not in present:
        df = df.withColumn("fetch_error", F.lit(None).cast("string"))
        present.append("fetch_error")
    # Failed pages enter no step: their html is emptied.
    df = df.withColumn("html", F.when(F.col("fetch_error").isNull(), F.col("html")).otherwise(F.lit("")))
    docs = process_pages(df, config, responses, keep=tuple(present), counts=True)
    ok = F.col("fetch_error").isNull()
    return docs.select(
        "url", ok.alias("success"), F.when(ok, F.col("markdown")).otherwise(F.lit("")).alias("markdown"),
        F.col("fetch_error").alias("error"), result_content_type(F.lit("html"), ok).alias("content_type"),
        F.when(ok, F.col("_counts.internal") + F.col("_counts.external")).alias("links_count"),
        F.when(ok, F.col("_counts.images")).alias("images_count"), ok.alias("js_executed"),
        F.when(ok, F.col("steps_applied")).alias("pipeline_steps"), F.when(ok, F.col("title")).alias("extracted_title"),
        *[c for c in present if c != "fetch_error"])


# O1
def run_batch(pages: DataFrame, pdf_pages: DataFrame | None = None, config: PipelineConfig = PipelineConfig(),
              responses: DataFrame | None = None) -> DataFrame:
    """Results of all pages and PDF files; a failing item is a row with its error and stops nothing."""
    parts = to_result(page_outcomes(pages, config, responses))
    if pdf_pages is not None:
        parts = parts.unionByName(to_result(pdf_results(pdf_pages, config.max_pdf_mb)))
    return parts
