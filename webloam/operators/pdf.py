"""PDF assembly: page texts and metadata to one Markdown document per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloam.functions.text import clean_pdf_text, let, parse_pdf_date, strip

_MB = 1024 * 1024


# P1
def pdf_size_error(file_size: Column, max_mb: int | None) -> Column:
    """Error text for a file above the limit, else NULL; without a limit always NULL."""
    if max_mb is None:
        return F.lit(None).cast("string")
    return F.when(file_size > max_mb * _MB, F.concat(
        F.lit("PDF too large: "), F.format_string("%.1f", file_size / F.lit(float(_MB))), F.lit(f"MB (max: {max_mb}MB)")))


def pdf_size_gate(pdfs: DataFrame, max_mb: int) -> DataFrame:
    """(doc_id, file_size, success, error) per file row."""
    error = pdf_size_error(F.col("file_size"), max_mb)
    return pdfs.withColumn("error", error).withColumn("success", F.col("error").isNull())


# P2
def pdf_metadata(meta: Column, pages: Column, file_size: Column) -> Column:
    """Metadata struct: empty texts become NULL, dates become ISO texts."""
    def text(name: str) -> Column:
        return F.when(F.length(meta[name]) > 0, meta[name]).alias(name)

    return F.struct(
        text("title"), text("author"), text("subject"), text("creator"), text("producer"),
        parse_pdf_date(meta["creationDate"]).alias("creation_date"),
        parse_pdf_date(meta["modDate"]).alias("modification_date"),
        pages.cast("int").alias("pages"), file_size.cast("long").alias("file_size"))


def assembled_text(info: Column, pages: Column) -> Column:
    """Markdown of a file out of its metadata and its ordered ``array<struct<page_num, text>>``."""
    def meta_line(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"**{label}:** "), value))

    lines = F.array_compact(F.array(
        meta_line("Author", info["author"]), meta_line("Subject", info["subject"]),
        F.when(info["pages"] > 0, meta_line("Pages", info["pages"].cast("string"))),
        meta_line("Creation date", info["creation_date"])))
    head = F.concat(F.lit("# "), F.coalesce(info["title"], F.lit("PDF Document")), F.lit("\n"))
    block = let(lines, lambda ls: F.when(F.size(ls) > 0, F.array(F.array_join(ls, "\n"), F.lit("\n---\n"))).otherwise(
        F.array().cast("array<string>")))
    filled = F.filter(pages, lambda p: F.length(strip(p["text"])) > 0)
    body = F.flatten(F.transform(filled, lambda p: F.array(
        F.concat(F.lit("\n## Page "), p["page_num"].cast("string"), F.lit("\n")), clean_pdf_text(p["text"]))))
    return F.array_join(F.concat(F.array(head), block, body), "\n")


# P3
def assemble_pdf_markdown(pdf_pages: DataFrame, max_mb: int | None = None) -> DataFrame:
    """(doc_id, url, info, markdown, error): one row per file.

    All pages of a file are kept unless the caller gives a limit on files. Texts that will not be written, those of files above
    the limit or with ``fetch_error``, are left out before the grouping, so a group holds what its document will.
    """
    error = pdf_size_error(F.col("file_size"), max_mb)
    if "fetch_error" in pdf_pages.columns:
        error = F.coalesce(F.col("fetch_error"), error)
    page = F.when(error.isNull(), F.struct(F.col("page_num").alias("page_num"), F.col("text").alias("text")))
    extras = {c: F.max(c).alias(c) for c in ("fetch_error", "duration_ms") if c in pdf_pages.columns}
    grouped = pdf_pages.groupBy("doc_id").agg(
        F.max("url").alias("url"), F.max("meta").alias("meta"), F.max("file_size").alias("file_size"),
        F.count("page_num").alias("n"), F.sort_array(F.collect_list(page)).alias("texts"), *extras.values())
    fetched = F.col("fetch_error") if "fetch_error" in extras else F.lit(None).cast("string")
    return (
        grouped.withColumn("error", F.coalesce(fetched, pdf_size_error(F.col("file_size"), max_mb)))
        .withColumn("info", pdf_metadata(F.col("meta"), F.col("n"), F.col("file_size")))
        .select("doc_id", "url", F.when(F.col("error").isNull(), F.col("info")).alias("info"),
                F.when(F.col("error").isNull(), assembled_text(F.col("info"), F.col("texts"))).otherwise(F.lit(""))
                .alias("markdown"), "error", *[c for c in ("duration_ms",) if c in extras])
    )


# P4
def pdf_results(pdf_pages: DataFrame, max_mb: int | None = None) -> DataFrame:
    """Result columns of the PDF branch: 200 on success, NULL status otherwise."""
    docs = assemble_pdf_markdown(pdf_pages, max_mb)
    ok = F.col("error").isNull()
    return docs.select(
        "doc_id", "url", ok.alias("success"), "markdown", "error", F.lit("pdf").alias("content_type"),
        F.when(ok, F.lit(200)).alias("http_status_code"),
        F.col("info.title").alias("pdf_title"), F.col("info.author").alias("pdf_author"),
        F.col("info.pages").alias("pdf_pages"), F.col("info.creation_date").alias("pdf_creation_date"),
        *[c for c in ("duration_ms",) if c in docs.columns])
