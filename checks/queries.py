"""The registered queries: one per operator of the inventory, over the whole given tables.

Results are flattened to plain columns (arrays joined, instants as microseconds).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from webloam.functions import html as H
from webloam.functions import outcome as OC
from webloam.functions import text as X
from webloam.operators import attempts as W
from webloam.operators import audit as A
from webloam.operators import content as C
from webloam.operators import pages as D
from webloam.operators import pdf as P
from webloam.operators import scientific as SC
from webloam.operators import search as J
from webloam.operators import usecases as U
from webloam.plans.batch import page_outcomes, run_batch, to_log_row, to_result
from webloam.plans.documents import process_pages
from webloam.schemas import LogFilters, PipelineConfig
from webloam.sources import logs as L
from webloam.sources import postings as PO
from webloam.sources.pages import read_pages, read_pdf_pages
from webloam.streaming.jobs import read_daily_stats, stream_daily_stats, stream_pages_to_logs

UTC = timezone.utc
us = lambda c: F.unix_micros(c)
QUERIES: dict = {}

TEMPLATE = "Rules first.\n\n\n\nNo {{ braces }} are read.\n\n{{ content }}\n\n---\n\nAnswer only."
TERMS = J.Terms(all_of=("the", "of"), none_of=("que",), prefix="tion")
PHRASE = J.Terms(phrase="of the")
LATE = datetime(2024, 1, 15, 12, tzinfo=UTC)


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f
    return register


def text_query(name: str, view: str, key: str, **columns):
    """A query that applies column functions to every row of a view."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(V, view)(spark, sf_dir).select(key, *[make().alias(c) for c, make in columns.items()])
    QUERIES[name] = run


def summary(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", us("timestamp")).withColumnRenamed("timestamp", "ts_us")


# --- sources and sinks -------------------------------------------------------------------

@query("s1_read_pages")
def _(spark, d):
    V.table(spark, d, "pages")
    return read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", "html", "page_title", "http_status_code")


@query("s2_read_pdf_pages")
def _(spark, d):
    return read_pdf_pages(spark, f"{d}/documents.parquet").select("doc_id", "url", "page_num", "text", "file_size")


@query("s3_append_logs")
def _(spark, d):
    path = V.scratch(spark, "logs")
    L.append_logs(V.logs(spark, d), path)
    return L.read_log_files(spark, path).select(
        "id", "url", us("timestamp").alias("ts_us"), "status", "content_length", F.col("log_date").cast("string").alias("day"))


@query("s4_read_logs")
def _(spark, d):
    props = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("bad"), "props")).otherwise(F.col("props"))
    raw = V.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), props.alias("response_headers"),
        F.concat(F.lit('["'), "event_type", F.lit('"]')).alias("redirects"),
        F.concat(F.lit('{"valid":true,"issuer":"u'), F.col("user_id").cast("string"), F.lit('"}')).alias("ssl_info"))
    return L.decode_json(raw).select(
        "id", "response_headers", F.col("response_headers_value")["k"].alias("k"),
        F.col("redirects_value")[0].alias("redirect"), F.col("ssl_info_value.issuer").alias("issuer"))


@query("s5_export_csv")
def _(spark, d):
    rows = L.csv_rows(V.logs(spark, d), LogFilters(status="success"))
    return rows.withColumn("Timestamp", us("Timestamp"))


@query("s6_export_json")
def _(spark, d):
    return L.json_rows(V.logs(spark, d), LogFilters(status="error")).select(
        "id", "url", us("timestamp").alias("ts_us"), "error_message", "content_type")


@query("s6_export_json_manifest")
def _(spark, d):
    return L.json_manifest(V.logs(spark, d), LogFilters(status="error"), V.AS_OF).select(
        "total_records", F.col("filters.status").alias("status"), F.col("filters.url_search").alias("url_search"))


@query("s7_format_markdown_report")
def _(spark, d):
    docs = V.docs(spark, d).select(
        "url", "markdown", F.col("source").alias("title"), F.lit("spa").alias("content_type"),
        F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("steps_applied"))
    path = V.scratch(spark, "reports")
    L.write_markdown_reports(docs, path)
    return spark.read.parquet(path).select("name", "report")


@query("s8_to_log_row")
def _(spark, d):
    logs = V.logs(spark, d)
    outcomes = logs.select(
        "url", (F.col("status") == "success").alias("success"), F.col("markdown_content").alias("markdown"),
        F.col("error_message").alias("error"), "content_type", "http_status_code", "duration_ms",
        F.when(F.col("duration_ms") % 2 == 0, F.concat("url", F.lit("#r"))).alias("redirected_url"),
        F.when(F.col("content_type") == "pdf", F.lit(3)).alias("pdf_pages"))
    results = to_result(outcomes)
    return to_log_row(results).select(
        "url", "status", "content_hash", "content_length", "error_message", "http_status_code",
        F.array_join("redirects", ",").alias("redirects"), "pdf_pages", "duration_ms")


@query("s8_to_result")
def _(spark, d):
    logs = V.logs(spark, d)
    outcomes = logs.select(
        "url", (F.col("status") == "success").alias("success"), F.col("markdown_content").alias("markdown"),
        F.when(F.col("duration_ms") % 3 == 0, F.lit(None)).otherwise(F.col("content_type")).alias("content_type"), "duration_ms",
        F.when(F.col("content_type") == "pdf", F.lit("T")).alias("pdf_title"))
    return to_result(outcomes).select("url", "success", "content_type", "content_hash", "duration_ms",
                                      F.col("pdf_metadata.title").alias("pdf_title"), "retry_count", "links_count")


# --- filters and projections -------------------------------------------------------------

@query("f1_get_log")
def _(spark, d):
    return A.get_log(V.logs(spark, d), "42").select("id", "url", "content_hash", "markdown_content")


def filter_query(name: str, filters: LogFilters):
    QUERIES[name] = lambda spark, d: A.filter_logs(V.logs(spark, d), filters).select("id", "url", "status")


filter_query("f2_filter_status", LogFilters(status="timeout"))
filter_query("f3_filter_content_type", LogFilters(content_type="pdf"))
filter_query("f4_filter_url_search", LogFilters(url_search="BLOG.t_er"))
filter_query("f5_filter_date_from", LogFilters(date_from=LATE))
filter_query("f6_filter_date_to", LogFilters(date_to=LATE))
filter_query("f7_filter_all", LogFilters("success", "spa", "example", datetime(2024, 1, 10, tzinfo=UTC), LATE))


@query("f8_summarize")
def _(spark, d):
    return summary(A.summarize(V.logs(spark, d)))


@query("f9_validate_logs")
def _(spark, d):
    e = V.table(spark, d, "events")
    raw = e.select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 11 != 0, F.lit("https://x.example/")).alias("url"),
        F.when(F.col("event_type") == "click", "success").otherwise(F.col("event_type")).alias("status"),
        F.lit("html").alias("content_type"), (F.round(F.col("value")).cast("long") - 100).alias("duration_ms"))
    valid, rejected = A.validate_logs(raw)
    return valid.select("id", F.lit("").alias("reasons")).unionByName(
        rejected.select("id", F.array_join("reasons", "; ").alias("reasons")))


@query("f10_validate_requests")
def _(spark, d):
    p = V.pages(spark, d)
    requests = p.select(
        "page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://"), "url"))
        .when(F.col("page_id") % 5 == 1, F.lit("https://")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 3 != 0, F.col("page_id") * 1000).cast("int").alias("timeout"))
    valid, rejected = A.validate_requests(requests)
    return valid.select("page_id", "timeout", F.lit("").alias("reasons")).unionByName(
        rejected.select("page_id", "timeout", F.array_join("reasons", "; ").alias("reasons")))


@query("f11_is_scientific_site")
def _(spark, d):
    url = F.regexp_replace("url", r"example\.org", "journals.PLOS.org")
    url = F.regexp_replace(url, r"example\.net", "link.springer.com")
    return V.pages(spark, d).select("page_id", OC.is_scientific_site(url).alias("scientific"),
                                    OC.is_scientific_site(F.concat(F.lit("/arxiv.org/"), "url")).alias("no_host"))


@query("f12_has_class_containing")
def _(spark, d):
    tokens = D.tokenize_html(V.marked_pages(spark, d))
    return tokens.filter(H.has_class_containing(F.col("tok"), "share")).select("page_id", "pos", "tok")


# --- search ------------------------------------------------------------------------------

@query("j1_search_logs")
def _(spark, d):
    return J.search_logs(V.logs(spark, d), TERMS, LogFilters(status="success")).select("id", "url")


@query("j1_search_phrase")
def _(spark, d):
    return J.search_logs(V.doc_logs(spark, d), PHRASE).select("id")


@query("j2_search_logs_like")
def _(spark, d):
    return J.search_logs_like(V.logs(spark, d), "Thing%the", LogFilters(content_type="spa")).select("id", "url")


def _posting_facts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("logs"), F.sum(F.size("positions")).alias("hits"),
        F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)).alias("positions"))


@query("j3_build_postings")
def _(spark, d):
    return _posting_facts(J.build_postings(V.doc_logs(spark, d)))


@query("j3_search_postings")
def _(spark, d):
    logs = V.doc_logs(spark, d)
    return J.search_with_postings(logs, J.build_postings(logs), PHRASE).select("id")


@query("j3_search_postings_prefix")
def _(spark, d):
    logs = V.doc_logs(spark, d)
    return J.search_with_postings(logs, J.build_postings(logs), J.Terms(prefix="of th", any_of=("que", "with"))).select("id")


@query("j4_postings_by_batch")
def _(spark, d):
    """First versions of all logs, then new versions of a third of them, a fifth removed, merged, a day of them added again."""
    path = V.scratch(spark, "postings-by-batch")
    rows = L.prepare_logs(V.doc_logs(spark, d))
    number = F.col("id").cast("long")
    old = rows.withColumn("markdown_content", F.when(number % 3 == 1, F.concat(F.lit("old version "), "markdown_content")).otherwise(F.col("markdown_content")))
    PO.add_postings(old, path, 0)
    PO.add_postings(rows.filter(number % 3 == 1), path, 1, replaces=True)
    PO.remove_postings(rows.filter(number % 5 == 2).select("id"), path, 2)
    PO.merge_postings(spark, path)
    PO.add_postings(rows.filter(number % 5 == 2), path, 3)
    return _posting_facts(PO.read_postings(spark, path))


@query("j4_maintain_postings")
def _(spark, d):
    logs_path, postings_path = V.scratch(spark, "logs"), V.scratch(spark, "postings")
    rows = L.prepare_logs(V.doc_logs(spark, d))
    rows.write.partitionBy("log_date").parquet(logs_path)
    keep_equal = J.maintain_postings(logs_path, postings_path)
    keep_equal(L.read_log_files(spark, logs_path), 0)
    keep_equal(L.read_log_files(spark, logs_path).filter(F.col("log_date") == "2024-01-02"), 1)
    return _posting_facts(spark.read.parquet(postings_path))


@query("j5_reinject_sections")
def _(spark, d):
    docs = V.docs(spark, d).select(F.col("doc_id").alias("page_id"), "markdown", "source")
    sections = V.documents(spark, d).filter(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("## Abstract\n\n"), "source").alias("scientific_content"))
    return SC.reinject_sections(docs, sections).select("page_id", "markdown")


# --- aggregations ------------------------------------------------------------------------

@query("g1_log_stats")
def _(spark, d):
    return A.log_stats(V.logs(spark, d))


@query("g2_daily_stats")
def _(spark, d):
    return A.daily_stats(V.logs(spark, d), V.AS_OF).withColumn("date", F.col("date").cast("string"))


@query("g3_success_rate")
def _(spark, d):
    return V.logs(spark, d).groupBy("content_type").agg(
        A.success_rate(F.count_if(F.col("status") == "success"), F.count(F.lit(1))).alias("rate"))


@query("g4_count_logs")
def _(spark, d):
    return A.count_logs(V.logs(spark, d), LogFilters(status="success", url_search="blog"))


@query("g5_full_stats")
def _(spark, d):
    days = F.transform("daily_stats", lambda x: F.concat_ws(
        ":", x["date"].cast("string"), x["count"].cast("string"), x["success"].cast("string")))
    return A.full_stats(V.logs(spark, d), V.AS_OF).withColumn("daily_stats", F.array_join(days, ";"))


@query("g6_link_image_counts")
def _(spark, d):
    return D.link_image_counts(V.linked_pages(spark, d))


# --- folds over blocks and attempts ------------------------------------------------------

text_query("w1_dedupe_consecutive_blocks", "noisy", "doc_id", markdown=lambda: X.dedupe_consecutive_blocks(F.col("markdown")))


@query("w2_resolve_attempts")
def _(spark, d):
    return W.resolve_attempts(V.attempts(spark, d))


# --- paging ------------------------------------------------------------------------------

@query("t1_page_logs")
def _(spark, d):
    return summary(A.page_logs(V.logs(spark, d), 3, 50, LogFilters(status="success")))


@query("t1_page_logs_far")
def _(spark, d):
    return summary(A.page_logs(V.logs(spark, d), 60, 50, LogFilters(status="success"), near=100))


@query("t1_page_logs_search")
def _(spark, d):
    return summary(A.page_logs(V.logs(spark, d), 2, 50, LogFilters(status="success", matching=J.match(J.Terms(phrase="of the", field="markdown")))))


@query("g4_count_search")
def _(spark, d):
    return A.count_logs(V.logs(spark, d), LogFilters(matching=J.match(J.Terms(phrase="of the", field="markdown"))))


@query("t1_page_meta")
def _(spark, d):
    return A.page_meta(V.logs(spark, d), 3, 50, LogFilters(status="success"))


@query("t2_page_logs_keyset")
def _(spark, d):
    import base64
    cursor = base64.b64encode(f"{int(LATE.timestamp() * 1_000_000)}|5".encode()).decode()
    return summary(A.page_logs_keyset(V.logs(spark, d), cursor, 40, status="success"))


@query("t3_cursors")
def _(spark, d):
    rows = V.logs(spark, d).select("id", "timestamp")
    coded = rows.withColumn("cursor", F.when(F.col("id").cast("long") % 4 == 0, F.concat(F.lit("!"), "id"))
                            .otherwise(A.encode_cursor(F.col("timestamp"), F.col("id"))))
    back = A.decode_cursor(F.col("cursor"))
    return coded.select("id", "cursor", us(back["timestamp"]).alias("ts_us"), back["id"].alias("back_id"))


@query("t4_recent_logs")
def _(spark, d):
    return summary(A.recent_logs(V.logs(spark, d)))


@query("t5_export_cap")
def _(spark, d):
    return A.newest_rows(V.logs(spark, d)).select("id", us("timestamp").alias("ts_us"), "content_length")


# --- scalar functions --------------------------------------------------------------------

text_query("n1_content_hash", "documents", "doc_id", hash=lambda: X.content_hash(F.col("text"), F.col("doc_id") % 2 == 0))
text_query("n2_content_length", "documents", "doc_id", length=lambda: X.content_length(F.when(F.col("doc_id") % 7 != 0, F.col("text"))))
text_query("n3_is_pdf_url", "pages", "page_id", pdf=lambda: OC.is_pdf_url(F.regexp_replace("url", r"\.html$", ".PDF/")),
           query=lambda: OC.is_pdf_url(F.concat("url", F.lit(".pdf"))))
_header = lambda: F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.concat(
    F.lit("Application/PDF; x="), "lang")).otherwise(F.concat(F.lit("text/html; "), "lang"))
text_query("n4_is_pdf_content_type", "documents", "doc_id", pdf=lambda: OC.is_pdf_content_type(_header()))
text_query("n5_detect_kind", "documents", "doc_id", kind=lambda: OC.detect_kind(
    _header(), F.concat(F.lit("https://x.example/"), "source", F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(""))))
text_query("n6_result_content_type", "documents", "doc_id", content_type=lambda: OC.result_content_type(
    F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("html"), F.col("doc_id") % 2 == 0))
text_query("n7_classify_status", "logs", "id", status=lambda: OC.classify_status(
    F.col("status") == "success", F.when(F.col("duration_ms") % 2 == 0, F.upper("error_message")).otherwise(F.col("error_message"))))
text_query("n8_is_browser_crash", "attempts", "url", attempt=lambda: F.col("attempt"), crash=lambda: OC.is_browser_crash(F.col("error")))
text_query("n9_is_retryable", "attempts", "url", attempt=lambda: F.col("attempt"), again=lambda: OC.is_retryable(F.col("error"), F.col("kind")))
_pdf_date = lambda: F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("D:2024"), F.lpad(F.col("n_chars").cast("string"), 10, "0"), F.lit("+01'00'"))) \
    .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("D:2024011"), (F.col("doc_id") % 10).cast("string"))).when(
        F.col("doc_id") % 4 == 2, F.col("lang")).otherwise(F.lit(""))
text_query("n10_parse_pdf_date", "documents", "doc_id", parsed=lambda: X.parse_pdf_date(_pdf_date()))
text_query("n11_clean_pdf_text", "documents", "doc_id", text=lambda: X.clean_pdf_text(
    F.concat(F.lit(" \x07\t "), F.replace("text", F.lit(". "), F.lit(".\n\n\n\t \x0b")), F.lit("\n\n"))))
text_query("n12_clean_markdown", "noisy", "doc_id", markdown=lambda: X.clean_markdown(F.col("markdown")))
text_query("n13_normalize_markdown_spacing", "headed", "doc_id", markdown=lambda: X.normalize_markdown_spacing(F.col("markdown")))
text_query("n14_extract_text_content", "noisy", "doc_id", text=lambda: X.extract_text_content(F.col("markdown")))
text_query("n15_strip_code_fence", "responses", "page_id", stage=lambda: F.col("stage"), text=lambda: X.strip_code_fence(F.col("response")))
text_query("n16_title_from_slug", "pages", "page_id", title=lambda: X.title_from_slug(
    F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/l'été_3d-"), F.element_at(F.split("url", "[./]"), 3), F.lit(".tar.html?x=1"))),
    plain=lambda: X.title_from_slug(F.col("url")))
text_query("n17_inject_title", "docs", "doc_id", **{
    name: (lambda field=name: X.inject_title(
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\n# "), "markdown")).otherwise(F.col("markdown")),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  Page \t "), "source")).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 5 == 0, F.col("lang")), F.col("url"))[field]) for name in ("markdown", "title")})
text_query("n18_inject_section", "docs", "doc_id", markdown=lambda: X.inject_section(
    F.col("markdown"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("## S\n\n"), "source")).otherwise("")))
text_query("n19_regex_clean", "noisy", "doc_id", markdown=lambda: X.regex_clean(F.col("markdown")),
           no_images=lambda: X.regex_clean(F.col("markdown"), include_images=False))
text_query("n20_json_fields", "events_", "event_id", k=lambda: X.from_json_field(F.col("props"), "map<string,string>")["k"],
           back=lambda: X.to_json_field(X.from_json_field(F.col("props"), "map<string,string>")))
text_query("n21_http_status_class", "events_", "event_id", status=lambda: X.http_status_class(
    F.when(F.col("event_id") % 9 != 0, F.round(F.col("value")).cast("int"))))
text_query("n22_truncate_chars", "documents", "doc_id", text=lambda: X.truncate_chars(F.col("text"), 5_000))

# --- pages -------------------------------------------------------------------------------


@query("d1_tokenize_html")
def _(spark, d):
    return D.tokenize_html(V.pages(spark, d)).select("page_id", "pos", "tok", "tag", "d", "end_pos")


@query("d2_prune_tags")
def _(spark, d):
    return D.prune_tags(V.pages(spark, d)).select("page_id", "html")


@query("d3_prune_class_id")
def _(spark, d):
    return D.prune_class_id(V.marked_pages(spark, d)).select("page_id", "html")


@query("d4_prune_dom")
def _(spark, d):
    return D.prune_dom(V.marked_pages(spark, d)).select("page_id", "html")


@query("d5_extract_abstracts")
def _(spark, d):
    return SC.extract_abstracts(V.science(spark, d))


@query("d6_extract_keywords")
def _(spark, d):
    return SC.extract_keywords(V.science(spark, d))


@query("d7_extract_body_sections")
def _(spark, d):
    return SC.extract_body_sections(V.science(spark, d))


@query("d8_scientific_preprocess")
def _(spark, d):
    return SC.scientific_preprocess(V.science(spark, d)).select("page_id", "html", "scientific_content")


@query("d9_extract_main_content")
def _(spark, d):
    return D.extract_main_content(V.linked_pages(spark, d))


@query("d9_markdown_structure")
def _(spark, d):
    return D.extract_main_content(V.structured(spark, d))


@query("d10_page_fallback_markdown")
def _(spark, d):
    return D.page_fallback_markdown(V.pages(spark, d))


@query("d11_choose_extraction")
def _(spark, d):
    pick = C.choose_extraction(
        F.when(F.col("doc_id") % 5 != 0, F.expr("left(text, length(text) div cast(doc_id % 6 + 1 as int))")),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    return V.documents(spark, d).select("doc_id", pick.alias("p")).select("doc_id", "p.markdown", "p.step")


@query("d12_page_titles")
def _(spark, d):
    return D.page_titles(V.linked_pages(spark, d))


@query("d12_html5_references")
def _(spark, d):
    return D.page_titles(V.structured(spark, d)).select("page_id", "page_title")


def _flat_docs(docs: DataFrame) -> DataFrame:
    return docs.select("page_id", "url", "markdown", "title", F.array_join("steps_applied", ",").alias("steps"))


@query("d13_process_pages")
def _(spark, d):
    return _flat_docs(process_pages(V.pages(spark, d)))


@query("d13_process_pages_scientific")
def _(spark, d):
    return _flat_docs(process_pages(V.science(spark, d)))


@query("d14_scrub_html")
def _(spark, d):
    return D.scrub_html_for_prompt(V.linked_pages(spark, d)).select("page_id", "html")


@query("o1_run_batch")
def _(spark, d):
    pages = V.pages(spark, d).withColumn("fetch_error", F.when(F.col("page_id") % 10 == 3, F.lit("Timeout after 30000ms")))
    return run_batch(pages, V.pdf_pages(spark, d)).select(
        "url", "success", "error", "content_type", "content_hash", "content_length", "links_count", "images_count",
        "http_status_code", "pdf_pages", F.array_join("pipeline_steps", ",").alias("steps"))


@query("o2_urls_to_refetch")
def _(spark, d):
    ids = V.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return A.urls_to_refetch(V.logs(spark, d), ids)


# --- prompts, answers, structure ---------------------------------------------------------

@query("l1_build_prompts")
def _(spark, d):
    return C.build_prompts(V.docs(spark, d), TEMPLATE, "markdown").select("doc_id", "prompt")


@query("l2_apply_html_extractions")
def _(spark, d):
    pages = V.docs(spark, d).select(F.col("doc_id").alias("page_id"), "url")
    return C.apply_html_extractions(pages, V.responses(spark, d)).select("page_id", "html_answer")


@query("l3_apply_structure_fixes")
def _(spark, d):
    docs = V.docs(spark, d).select(
        F.col("doc_id").alias("page_id"), "markdown",
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("llm_html_sanitize"))).otherwise(F.array(F.lit("main_content"))).alias("steps_applied"))
    return C.apply_structure_fixes(docs, V.responses(spark, d)).select(
        "page_id", "markdown", F.array_join("steps_applied", ",").alias("steps"))


text_query("l4_normalize_headings", "headed", "doc_id", markdown=lambda: C.normalize_headings(F.col("markdown")))
text_query("l5_strip_interface_residue", "docs", "doc_id", markdown=lambda: C.strip_interface_residue(F.concat(
    F.lit("Share\n"), F.replace("markdown", F.lit("\n"), F.lit("\n Please wait \n- - -\n[x]( ) ")), F.lit("\nDownload it"))))

# --- row removal -------------------------------------------------------------------------


def _removal(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    kept, removed = pair
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n").unionByName(
        removed.select(F.lit("removed").alias("part"), F.col("removed_count").alias("n")))


@query("m1_delete_log")
def _(spark, d):
    return A.delete_log(V.logs(spark, d), "42")[0].select("id", "url")


@query("m2_cleanup_old_logs")
def _(spark, d):
    return _removal(A.cleanup_old_logs(V.logs(spark, d), V.AS_OF + timedelta(days=14)))


@query("m3_delete_old_logs")
def _(spark, d):
    return A.delete_old_logs(V.logs(spark, d), V.AS_OF, 9)[0].select("id", us("timestamp").alias("ts_us"))


@query("m4_clear_all_logs")
def _(spark, d):
    return _removal(A.clear_all_logs(V.logs(spark, d)))


def _on_disk(spark: SparkSession, d: str) -> str:
    path = V.scratch(spark, "kept-logs")
    L.append_logs(V.logs(spark, d), path)
    return path


@query("f1_get_log_at")
def _(spark, d):
    return A.get_log(L.read_log_files(spark, _on_disk(spark, d)), "42").select("id", "url", "content_hash", "markdown_content")


@query("m1_delete_log_at")
def _(spark, d):
    path = _on_disk(spark, d)
    L.delete_log_at(spark, path, "42")
    return L.read_log_files(spark, path).select("id", "url")


@query("m3_delete_old_logs_at")
def _(spark, d):
    path = _on_disk(spark, d)
    removed = L.delete_old_logs_at(spark, path, V.AS_OF + timedelta(hours=12), 9)
    return L.read_log_files(spark, path).select("id", us("timestamp").alias("ts_us"), F.lit(removed).cast("long").alias("removed"))


@query("m4_clear_logs_at")
def _(spark, d):
    path = _on_disk(spark, d)
    removed = L.clear_logs_at(spark, path)
    left = L.read_log_files(spark, path).agg(F.count(F.lit(1)).alias("n"))
    return left.select(F.lit("kept").alias("part"), "n").unionByName(
        left.select(F.lit("removed").alias("part"), F.lit(removed).cast("long").alias("n")))


# --- PDF ---------------------------------------------------------------------------------

@query("p1_pdf_size_gate")
def _(spark, d):
    files = V.pdf_pages(spark, d).groupBy("doc_id").agg((F.max("file_size") * 700).alias("file_size"))
    return P.pdf_size_gate(files, 2).select("doc_id", "file_size", "success", "error")


@query("p2_pdf_metadata")
def _(spark, d):
    files = V.pdf_pages(spark, d).groupBy("doc_id").agg(
        F.max("meta").alias("meta"), F.count("page_num").alias("n"), F.max("file_size").alias("file_size"))
    return files.select("doc_id", P.pdf_metadata(F.col("meta"), F.col("n"), F.col("file_size")).alias("m")).select("doc_id", "m.*")


@query("p3_assemble_pdf_markdown")
def _(spark, d):
    return P.assemble_pdf_markdown(V.pdf_pages(spark, d)).select("doc_id", "markdown", "error")


@query("p4_pdf_results")
def _(spark, d):
    return P.pdf_results(V.pdf_pages(spark, d))


# --- streams -----------------------------------------------------------------------------

@query("x1_stream_pages_to_logs")
def _(spark, d):
    V.pages(spark, d)
    out = V.scratch(spark, "stream-logs")
    stream_pages_to_logs(spark, f"{d}/page[s].parquet", out, V.scratch(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema(L.LOG_FILES).parquet(out).select("url", "status", "content_type", "content_hash", "content_length", "links_count")


@query("x2_stream_daily_stats")
def _(spark, d):
    source, out = V.scratch(spark, "log-files"), V.scratch(spark, "daily")
    V.logs(spark, d).select("timestamp", "status").write.parquet(source)
    stream = spark.readStream.schema("timestamp timestamp, status string").parquet(source)
    stream_daily_stats(stream, out, V.scratch(spark, "daily-checkpoint")).awaitTermination()
    return read_daily_stats(spark, out).withColumn("date", F.col("date").cast("string"))


# --- use cases ---------------------------------------------------------------------------

@query("u1_keyword_density")
def _(spark, d):
    return U.keyword_density(V.docs(spark, d))


@query("u2_heading_structure")
def _(spark, d):
    return U.heading_structure(V.headed(spark, d))


@query("u3_thin_content")
def _(spark, d):
    return U.thin_content(V.docs(spark, d), 120)


@query("u4_content_changes")
def _(spark, d):
    return U.content_changes(V.logs(spark, d)).select("url", us("timestamp").alias("ts_us"), "id", "previous_hash", "content_hash")


@query("u5_new_urls")
def _(spark, d):
    # URLs enter the log on different days, by their length
    logs = V.logs(spark, d).withColumn("timestamp", F.timestamp_micros(us("timestamp") + F.length("url") % 20 * F.lit(86_400_000_000)))
    return U.new_urls(logs, datetime(2024, 1, 15, tzinfo=UTC)).withColumn("first_seen", us("first_seen"))
