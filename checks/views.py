"""Views that turn the given tables into the inputs of the operators.

Everything grows with the given tables; nothing is sampled or cut.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
FAILED = ("error", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name: in the shared folder of the cluster, or in a local one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = shared or tempfile.mkdtemp(prefix="webloam-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def utc_instant(column: str) -> Column:
    """The instant of a UTC time that is stored without a zone, whatever the session's zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"))


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows: every event is a fetch of a page that answered with a document."""
    p, d = pages(spark, sf_dir), documents(spark, sf_dir)
    kind = F.col("event_type")
    failed = kind.isin(*FAILED)
    e = table(spark, sf_dir, "events").select(
        "event_id", utc_instant("ts").alias("timestamp"), "event_type", "value",
        (F.col("event_id") % _count(p)).alias("page_id"), (F.col("event_id") % _count(d)).alias("doc_id"))
    texts = d.select("doc_id", "text", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("len"))
    joined = e.join(p.select("page_id", "url"), "page_id").join(texts, "doc_id")
    return joined.select(
        F.col("event_id").cast("string").alias("id"), "url", "timestamp",
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"),
        F.when(kind == "error", "error").when(kind == "signup", "timeout").otherwise("success").alias("status"),
        F.when(kind == "error", 500).when(kind == "signup", F.lit(None)).otherwise(200).cast("int").alias("http_status_code"),
        F.when(kind == "error", "HTTP error 500").when(kind == "signup", "Timeout after 30000ms").alias("error_message"),
        F.when(F.col("event_id") % 10 == 0, "pdf").when(failed, "html").otherwise("spa").alias("content_type"),
        F.when(failed, "").otherwise(F.col("text")).alias("markdown_content"),
        F.when(~failed, F.col("hash")).alias("content_hash"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.col("len")).alias("content_length"),
        F.lit(0).alias("links_count"), F.lit(0).alias("images_count"))


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log rows, one day each out of five."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("https://"), "source", F.lit("/"), "lang").alias("url"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 5) * 86400).alias("timestamp"),
        F.col("text").alias("markdown_content"), F.lit("success").alias("status"), F.lit("spa").alias("content_type"),
        F.lit(1).cast("long").alias("duration_ms"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the URL of a page and a few headings put in."""
    p, d = pages(spark, sf_dir), documents(spark, sf_dir)
    return (
        d.withColumn("page_id", F.col("doc_id") % _count(p)).join(p.select("page_id", "url"), "page_id")
        .select("doc_id", "url", F.col("text").alias("markdown"), "lang", "source")
    )


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose every third line is a heading of a level that depends on its number."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(
        (i + F.col("doc_id")) % 3 == 0, F.concat(F.repeat(F.lit("#"), (((i * 7 + F.col("doc_id")) % 4) + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    return documents(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("markdown"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with links, images, player noise and repeated blocks between their lines."""
    noise = F.array(*[F.lit(x) for x in (
        "![](a.png) and [](u) and [t]( )", "0:00", "/", "LIVE", "-0:00", "Video Player is loading.",
        "Wow!", "! !", "‹›", "![alt]()", "[text](https://x.example/a) **bold** `code`", "  \t ")])

    def line(x: Column, i: Column) -> Column:
        pick = F.get(noise, ((i * 5 + F.col("doc_id")) % 12).cast("int"))
        return F.concat(x, F.lit("\n"), pick, F.when(i % 4 == 0, F.concat(F.lit("\n\n"), x, F.lit("\n\n"), x)).otherwise(F.lit("\n")))

    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("markdown"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose advertising blocks and lists carry furniture marks on some pages."""
    html = F.when(F.col("page_id") % 2 == 0, F.replace(F.col("html"), F.lit('<div class="ad">'), F.lit('<div class="ad Share-box">'))) \
        .otherwise(F.col("html"))
    html = F.when(F.col("page_id") % 3 == 0, F.replace(html, F.lit("<ul>"), F.lit('<ul id=main-menu>'))).otherwise(html)
    return pages(spark, sf_dir).withColumn("html", html)


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an og:title, images, links in the text and style and data-* attributes."""
    html = F.replace(F.col("html"), F.lit("<head>"), F.lit('<head><meta property="og:title" content="Og &amp; more">'))
    html = F.replace(html, F.lit("<article>"), F.concat(
        F.lit('<article style="a:b" data-n="1"><img src="/i.png" alt="pic"><p>Read <a href="'), F.col("url"),
        F.lit('">this very page</a> or <a href="https://other.example/x">another one</a> some day.</p>')))
    return pages(spark, sf_dir).withColumn("html", html)


def _escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def science(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article pages: abstract, keywords and body sections out of their text."""
    text = _escape(F.regexp_replace("text", r"\n", " "))
    html = F.concat(
        F.lit('<html><head><title>Article</title></head><body><div class="Abstracts"><div class="abstract author"><h2>Summary</h2>'
              '<div class="abstract-content"><p>'), text,
        F.lit('</p></div></div></div><div class="keywords"><h2>Keys</h2><span class="keyword">'), F.col("lang"),
        F.lit('</span> <span class="keyword">'), F.col("source"),
        F.lit('</span></div><div id="body"><div><section id="s1"><h2>Introduction</h2><p>'), text,
        F.lit('</p><div class="figure">'), text, F.lit('</div></section><section id="bibl1"><h2>Refs</h2><p>'), text,
        F.lit("</p></section></div></div><p>Rest of "), F.col("source"), F.lit("</p></body></html>"))
    host = F.when(F.col("doc_id") % 2 == 0, "https://www.plos.org/a/").otherwise("https://www.example.org/a/")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("page_id"), F.concat(host, F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with numbered lines, preformatted and quoted text, a table, emphasis and HTML 5 references."""
    items = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<li>"), _escape(x), F.lit("</li>"))), "")
    html = F.concat(
        F.lit("<html><head><title>Structure &copy 2020 &notit; &notin; &CounterClockwiseContourIntegral;</title></head><body><ol>"), items,
        F.lit("</ol><pre>"), _escape(F.col("text")), F.lit("</pre><blockquote><p>"), _escape(F.col("text")),
        F.lit("</p></blockquote><table><tr><th>Language</th><th>Source</th></tr><tr><td>"), F.col("lang"), F.lit("</td><td>"), F.col("source"),
        F.lit("</td></tr></table><p>By <em>"), F.col("source"), F.lit("</em> in <strong>"), F.col("lang"),
        F.lit("</strong>, <code>"), F.col("doc_id").cast("string"), F.lit("</code> &copy 2024 &notin;</p></body></html>"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files: every line is a page; one file in fifty is too large."""
    d = documents(spark, sf_dir)
    some = F.col("doc_id") % 3
    meta = F.struct(
        F.when(some == 0, F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(some == 1, F.col("source")).alias("author"), F.col("lang").alias("subject"),
        F.lit("").alias("creator"), F.lit(None).cast("string").alias("producer"),
        F.when(some == 0, F.concat(F.lit("D:202401"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("1030")))
        .when(some == 1, F.lit("Jan 2024")).alias("creationDate"), F.lit("").alias("modDate"))
    return d.select(
        "doc_id", F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"),
        F.posexplode(F.split("text", "\n")).alias("n", "text"),
        F.when(F.col("doc_id") % 50 == 7, 60 * 1024 * 1024).otherwise(F.col("n_chars")).cast("long").alias("file_size"),
        "source", "lang").select("doc_id", "url", (F.col("n") + 1).cast("int").alias("page_num"), "text", "file_size", meta.alias("meta"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetch attempts: three events in a row are the attempts of one request."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("https://site.example/"), F.floor(F.col("event_id") / 3).cast("string")).alias("url"),
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), kind.isin("click").alias("success"),
        F.when(kind == "error", "HTTP error 500").when(kind == "signup", "Timeout after 30000ms")
        .when(kind == "purchase", "Browser has been closed").when(kind == "view", "Network unreachable").alias("error"),
        F.when(F.col("user_id") % 5 == 0, "pdf").otherwise("html").alias("kind"),
        (F.col("event_id") % 2 == 0).alias("restarted"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: fenced html answers and structure answers of varying loss."""
    d = documents(spark, sf_dir)
    fenced = F.concat(F.lit("```markdown\n# Answer\n"), F.col("text"), F.lit("\n```"))
    html = d.select(F.col("doc_id").alias("page_id"), F.lit("html").alias("stage"),
                    F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.lit("too short")).alias("response"))
    fix = d.select(F.col("doc_id").alias("page_id"), F.lit("structure").alias("stage"),
                   F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Fixed\n"), F.col("text")))
                   .when(F.col("doc_id") % 3 == 1, F.expr("left(text, length(text) div 2)")).otherwise(F.lit("")).alias("response"))
    return html.unionByName(fix)


def events_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
