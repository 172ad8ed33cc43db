import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from checks import views as V
from checks.compare import TABLES, rows_of
from checks.oracles import SQL
from checks.queries import QUERIES
from webloam.plans.batch import run_batch, to_log_row
from webloam.schemas import PAGES
from webloam.sources.logs import LOG_FILES, clear_logs_at, delete_log_at, delete_old_logs_at, parts_of, read_log_files, write_batch
from webloam.sources.pages import conform
from webloam.streaming.jobs import read_daily_stats, stream_daily_stats, stream_pages_to_logs

SF = "/root/testdata/sf0.001"


def test_page_stream_writes_every_file_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [(i, f"https://e.com/{i}", f"<title>T{i}</title><p>text {i}</p>") for i in range(6)]
    pages = conform(spark.createDataFrame(rows, "page_id long, url string, html string"), PAGES)

    def run():
        stream_pages_to_logs(spark, source, out, checkpoint).awaitTermination()
        return spark.read.schema(LOG_FILES).parquet(out)

    pages.filter("page_id < 4").coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 4
    pages.filter("page_id >= 4").coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 6 and run().count() == 6
    expected = {r["url"]: r["content_hash"] for r in to_log_row(run_batch(pages)).collect()}
    assert {r["url"]: r["content_hash"] for r in run().collect()} == expected
    # the same batch again, on another day: the same ids, nothing twice
    before = sorted(r["id"] for r in run().collect())
    later = datetime.now(timezone.utc) + timedelta(days=3)
    write_batch(to_log_row(run_batch(pages.filter("page_id < 4").coalesce(1))), out, 0, now=later)
    assert sorted(r["id"] for r in read_log_files(spark, out).collect()) == before
    # retention on what the stream wrote
    assert delete_log_at(spark, out, before[0]) and run().count() == 5
    left = run().count()
    gone = delete_old_logs_at(spark, out, later + timedelta(days=29), 30)  # the first batch is of a later day and stays
    assert gone > 0 and run().count() == left - gone > 0
    left -= gone
    assert clear_logs_at(spark, out) == left and not parts_of(spark, out)


def test_daily_stream_counts_late_and_open_days(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(times):
        df = spark.createDataFrame([(t, "success") for t in times], "t string, status string")
        df.select(F.col("t").cast("timestamp").alias("timestamp"), "status").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("timestamp timestamp, status string").parquet(source)
        stream_daily_stats(stream, out, checkpoint).awaitTermination()

    run(["2024-01-01 01:00", "2024-01-01 23:00", "2024-01-02 10:00", "2024-01-05 00:00"])
    run(["2024-01-01 05:00", "2024-01-09 00:00"])
    got = read_daily_stats(spark, out).orderBy("date").collect()
    assert [(str(r["date"]), r["count"]) for r in got] == [("2024-01-01", 3), ("2024-01-02", 1), ("2024-01-05", 1), ("2024-01-09", 1)]


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES) and all(SQL.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["g5_full_stats", "t2_page_logs_keyset", "d4_prune_dom", "d9_extract_main_content", "w2_resolve_attempts",
                                  "n19_regex_clean", "j1_search_logs", "p3_assemble_pdf_markdown", "d8_scientific_preprocess"])
def test_twins_agree(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns) and rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_statistics_read_the_logs_once(spark):
    plan = QUERIES["g5_full_stats"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_type") and plan.count("Join Inner") == 2 and "Cartesian" not in plan
    assert V.AS_OF.tzinfo is not None
