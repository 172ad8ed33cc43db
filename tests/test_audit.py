import base64
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from webloam.operators import audit as A
from webloam.operators import usecases as U
from webloam.schemas import LOG, LogFilters
from webloam.sources import logs as L
from webloam.sources.pages import conform

UTC = timezone.utc
NOW = datetime(2024, 3, 10, 12, tzinfo=UTC)


def make(spark, rows):
    """rows: (id, url, timestamp, status, content_type, duration, length, hash)."""
    df = spark.createDataFrame(rows, "id string, url string, timestamp timestamp, status string, content_type string, "
                                     "duration_ms long, content_length long, content_hash string")
    return conform(df, LOG)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(f"l{i:02d}", f"https://example.com/{i}", NOW - timedelta(hours=i // 2), "error" if i % 5 == 0 else "success",
             ("html", "pdf", "spa")[i % 3], 100 + i, 10 * i, f"h{i % 4}") for i in range(25)]
    return make(spark, rows).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_offset_pages(logs):
    pages = [ids(A.page_logs(logs, p, 10)) for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [10, 10, 5] and len(set(sum(pages, []))) == 25 and pages[0][:3] == ["l01", "l00", "l03"]
    assert A.page_meta(logs, 1, 10).first() == (25, 1, 10, 3)
    assert A.page_meta(logs.limit(0), 1, 10).first() == (0, 1, 10, 1)
    with pytest.raises(ValueError):
        A.page_logs(logs, 1, 5)


def test_keyset_pages_are_disjoint_and_complete(logs):
    cursor, seen, rounds = None, [], 0
    while True:
        rows = A.page_logs_keyset(logs, cursor, 10).collect()
        seen += [r["id"] for r in rows]
        rounds += 1
        cursor = rows[0]["next_cursor"]
        if not rows[0]["has_more"]:
            break
    assert rounds == 3 and cursor is None and len(seen) == 25 == len(set(seen)) and seen == ids(A.page_logs(logs, 1, 100))


def test_bad_cursors_are_ignored(logs):
    first = ids(A.page_logs_keyset(logs, None, 10))
    for bad in ("invalid-cursor", "!!!invalid!!!", base64.b64encode(b"x|y").decode(), base64.b64encode(b"12").decode()):
        assert A.parse_cursor(bad) is None and ids(A.page_logs_keyset(logs, bad, 10)) == first
    assert len(ids(A.page_logs_keyset(logs, None, 10, status="error"))) == 5


def test_keyset_bound_reaches_the_scan(spark, logs, tmp_path):
    L.append_logs(logs, str(tmp_path / "t"))
    table = L.read_log_files(spark, str(tmp_path / "t"))
    cursor = A.page_logs_keyset(table, None, 10).first()["next_cursor"]
    plan = A.page_logs_keyset(table, cursor, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(timestamp" in plan and "TakeOrderedAndProject" in plan and "markdown_content" not in plan
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_statistics(spark, logs):
    row = A.full_stats(logs, NOW, 7).first()
    single = A.log_stats(logs).first()
    assert all(row[c] == single[c] for c in single.asDict())
    assert (row["total_scrapes"], row["success_count"], row["success_rate"]) == (25, 20, 80.0)
    days = [tuple(d) for d in row["daily_stats"]]
    assert days == [tuple(r) for r in A.daily_stats(logs, NOW, 7).collect()] and sum(d[1] for d in days) == 25
    empty = A.full_stats(logs.limit(0), NOW).first()
    assert empty["total_scrapes"] == 0 and empty["avg_duration_ms"] is None and empty["total_content_length"] == 0
    assert empty["success_rate"] == 0 and empty["daily_stats"] == []
    four = make(spark, [(str(i), "u", NOW, "success" if i else "error", "html", 1, 1, None) for i in range(4)])
    assert A.full_stats(four, NOW).first()["success_rate"] == 75.0


def test_filters(logs):
    assert A.count_logs(logs, LogFilters()).first()[0] == 25
    assert ids(A.filter_logs(logs, LogFilters(url_search="EXAMPLE.com/1_"))) == [f"l{i}" for i in range(10, 20)]
    both = LogFilters(status="success", content_type="pdf", date_from=NOW - timedelta(hours=3), date_to=NOW)
    assert ids(A.filter_logs(logs, both)) == ["l01", "l04", "l07"]
    assert A.filter_logs(logs, LogFilters(url_search="a\\b")).count() == 0
    assert ids(A.get_log(logs, "l07")) == ["l07"] and ids(A.get_log(logs, "none")) == []
    assert ids(A.recent_logs(logs, 2)) == ["l01", "l00"]


def test_retention_on_frames(spark, logs):
    old = make(spark, [("old", "u", NOW - timedelta(days=60), "success", "html", 1, 1, None)])
    kept, removed = A.cleanup_old_logs(logs.unionByName(old), NOW)
    assert kept.count() == 25 and removed.first()[0] == 1
    kept, removed = A.delete_log(logs, "l03")
    assert kept.count() == 24 and removed.first()[0] == 1
    assert A.delete_log(logs, "none")[1].first()[0] == 0
    kept, removed = A.clear_all_logs(logs)
    assert kept.count() == 0 and removed.first()[0] == 25 and kept.schema == logs.schema


def test_log_table_on_disk(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    extra = logs.limit(1).select("url", "status", "content_type", "duration_ms").withColumn("redirects", F.array(F.lit("r"))) \
        .withColumn("response_headers", F.lit("not json"))
    L.append_logs(logs, path)
    L.append_logs(extra, path, now=NOW - timedelta(days=40))
    back = L.read_logs(spark, path)
    assert back.count() == 26 and back.filter("id is null or timestamp is null").count() == 0
    [new] = back.filter("response_headers is not null").collect()
    assert new["response_headers"] == "not json" and new["response_headers_value"] is None and new["redirects_value"] == ["r"]
    assert L.delete_log_at(spark, path, "l07") and not L.delete_log_at(spark, path, "l07")
    assert L.delete_old_logs_at(spark, path, NOW, 30) == 1
    assert L.delete_old_logs_at(spark, path, NOW + timedelta(days=30, hours=-3), 30) == 17
    assert sorted(ids(L.read_log_files(spark, path))) == ["l00", "l01", "l02", "l03", "l04", "l05", "l06"]
    assert L.clear_logs_at(spark, path) == 7 and L.days_of(spark, path) == []


def test_exports(spark, logs, tmp_path):
    L.export_csv(logs, str(tmp_path / "csv"), LogFilters(status="error"))
    [file] = [f for f in (tmp_path / "csv").iterdir() if f.suffix == ".csv"]
    lines = file.read_text().splitlines()
    assert lines[0] == "ID,URL,Timestamp,Status,Content Type,Duration (ms),Content Length,HTTP Status,Error,Links,Images"
    assert len(lines) == 6 and lines[1].startswith("l00,https://example.com/0,") and lines[1].endswith(",,,,")
    L.export_json(logs, str(tmp_path / "json"), NOW, LogFilters(status="error"))
    manifest = spark.read.json(str(tmp_path / "json/manifest")).first()
    assert manifest["total_records"] == 5 and manifest["filters"]["status"] == "error"
    rows = [json.loads(x) for f in (tmp_path / "json/logs").glob("*.json") for x in f.read_text().splitlines()]
    assert len(rows) == 5 and "markdown_content" not in rows[0]
    assert "markdown_content" in L.json_rows(logs, include_content=True).columns and L.json_rows(logs, cap=3).count() == 3


def test_exports_and_newest_rows_keep_all(spark, logs):
    untimed = logs.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("id", F.lit("none"))
    both = logs.unionByName(untimed)
    assert A.newest_rows(both).count() == A.newest_rows(both, n=26).count() == L.csv_rows(both).count() == 26
    assert A.newest_rows(both, n=25).filter("id = 'none'").count() == 0 and A.newest_rows(both, n=3).count() == 3


def test_reports_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(f"https://e.com/a?x={k}", "T", f"body {k}", "html", ["s"]) for k in range(3)],
                                 "url string, title string, markdown string, content_type string, steps_applied array<string>")
    L.write_markdown_reports(docs, str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).collect()
    assert len({r["url"] for r in rows}) == 3 and {r["name"] for r in rows} == {"e.com_a.md"}
    assert all(r["report"].endswith(f"body {r['url'][-1]}") for r in rows)


def test_validation(spark):
    df = spark.createDataFrame([("a", "u", "success", "html", 1), ("b", None, "odd", "html", -1), ("c", "u", None, "spa", None)],
                               "id string, url string, status string, content_type string, duration_ms long")
    valid, rejected = A.validate_logs(df)
    assert ids(valid) == ["a"] and {r["id"]: len(r["reasons"]) for r in rejected.collect()} == {"b": 3, "c": 2}
    requests = spark.createDataFrame([("https://e.com/a", None), ("HTTP://e.com", 1000), ("ftp://e.com", 5000), ("https://", 5000),
                                      ("https://e.com", 999), ("https://e.com", 120001)], "url string, timeout int")
    valid, rejected = A.validate_requests(requests)
    assert sorted(r["timeout"] for r in valid.collect()) == [1000, 30000] and rejected.count() == 4


def test_use_cases(spark, logs):
    seen = sorted(logs.collect(), key=lambda r: (r["timestamp"], r["id"]))
    one = logs.withColumn("url", F.lit("same"))
    expected = [(b["id"], a["content_hash"]) for a, b in zip(seen, seen[1:]) if a["content_hash"] != b["content_hash"]]
    got = [(r["id"], r["previous_hash"]) for r in U.content_changes(one).collect()]
    assert sorted(got) == sorted(expected)
    assert U.new_urls(logs, NOW).count() == 2
    assert ids(A.urls_to_refetch(logs, spark.createDataFrame([("l02",), ("x",)], "id string")).withColumn("id", F.col("url"))) == ["https://example.com/2"]
    docs = spark.createDataFrame([(1, "# A\n## B\n#### C\n## D\n# E\ntext"), (2, "plain words"), (3, "")], "doc_id long, markdown string")
    assert [tuple(r)[1:] for r in U.heading_structure(docs).orderBy("ordinal").collect()] == [
        (0, 1, "A", None), (1, 2, "B", 0), (2, 4, "C", 1), (3, 2, "D", 0), (4, 1, "E", None)]
    assert sorted(tuple(r) for r in U.thin_content(docs, 3).collect()) == [(2, 2), (3, 0)]
    density = {r["term"]: r["share"] for r in U.keyword_density(docs).filter("doc_id = 2").collect()}
    assert density == {"plain": 0.5, "words": 0.5}
