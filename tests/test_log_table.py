"""The log table and its postings on disk: point lookups, far pages, broken runs, postings by batch, the daily stream's late rows."""

import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from webloam.operators import audit as A
from webloam.operators import search as J
from webloam.operators import usecases as U
from webloam.schemas import LogFilters
from webloam.sources import logs as L
from webloam.sources import postings as PO
from webloam.streaming.jobs import read_daily_stats, recount_days, stream_daily_stats

UTC = timezone.utc


def log_rows(spark, n, step=3600):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("https://e.com/"), F.col("id") % 7).alias("url"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * step).alias("timestamp"), F.lit("success").alias("status"),
        F.lit("spa").alias("content_type"), F.lit(1).cast("long").alias("duration_ms"),
        F.lit(2).cast("long").alias("content_length"), F.lit(200).alias("http_status_code"),
        F.concat(F.lit("word"), F.col("id") % 5, F.lit(" common text "), F.col("id")).alias("markdown_content"))


# lookups and far pages


def test_files_carry_bloom_filters_of_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "logs")
    L.append_logs(log_rows(spark, 500, 60), path)
    L.write_batch(log_rows(spark, 100, 60).drop("id"), path, 4)
    found = duckdb.sql(f"SELECT bloom_filter_offset IS NOT NULL AS b FROM parquet_metadata('{path}/*/*/*.parquet') WHERE path_in_schema = 'id'").fetchall()
    assert found and all(r[0] for r in found)
    absent = duckdb.sql(f"SELECT bool_and(bloom_filter_excludes) FROM parquet_bloom_probe('{path}/*/batch_id=-1/*.parquet', 'id', 'no such id')").fetchall()
    assert absent == [(True,)]
    assert A.get_log(L.read_log_files(spark, path), "77").count() == 1 and A.get_log(L.read_log_files(spark, path), "-77").count() == 0


def test_bloom_filters_are_as_large_as_their_ids_ask(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    L.append_logs(log_rows(spark, 100, 60), few)
    L.append_logs(log_rows(spark, 20_000, 1).coalesce(1), many)
    assert L.delete_log_at(spark, few, "7")
    sizes = lambda path: [r[0] for r in duckdb.sql(
        f"SELECT bloom_filter_length FROM parquet_metadata('{path}/*/*/*.parquet') WHERE path_in_schema = 'id'").fetchall()]
    assert max(sizes(few)) < 2_000 and 10_000 < max(sizes(many)) < 200_000
    found = duckdb.sql(" UNION ALL ".join(
        f"SELECT bloom_filter_excludes FROM parquet_bloom_probe('{many}/*/*/*.parquet', 'id', 'no{k}')" for k in range(300))).fetchall()
    assert sum(not r[0] for r in found) <= 0.01 * len(found)


def test_files_are_packed_tightly(spark, tmp_path):
    pq = pytest.importorskip("pyarrow.parquet")
    path = str(tmp_path / "logs")
    L.append_logs(log_rows(spark, 100), path)
    L.write_batch(log_rows(spark, 50).drop("id"), path, 4)
    assert L.delete_log_at(spark, path, "7")
    files = [str(f) for f in (tmp_path / "logs").rglob("*.parquet")]
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(k).compression for f in files for k in range(3)} == {"ZSTD"}


def test_rows_are_exchanged_only_where_files_would_be_small(spark, tmp_path, monkeypatch):
    pq = pytest.importorskip("pyarrow.parquet")
    exchanged, real = [], L.written

    def spied(rows, mode):
        exchanged.append("RebalancePartitions" in rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, mode)

    monkeypatch.setattr(L, "written", spied)
    mixed = log_rows(spark, 20_000, 10).withColumn("id", F.when(F.col("id").cast("int") % 9 != 0, F.col("id")))  # some have no id, some come twice
    mixed = mixed.unionByName(mixed.filter("id like '%7'")).repartition(4)
    sparse = log_rows(spark, 500).withColumn("timestamp", F.when(F.col("id") != "3", F.col("timestamp")))
    for name, rows in (("full", mixed), ("thin", sparse), ("one task", mixed.coalesce(1)), ("none", sparse.limit(0))):
        path, now = str(tmp_path / name), datetime(2023, 11, 14, tzinfo=UTC)
        L.append_logs(rows, path, now)
        kept = lambda df: sorted((r["id"] or "", r["timestamp"], r["log_date"]) for r in df.select(
            F.when(F.length("id") < 9, F.col("id")).alias("id"), "timestamp", "log_date").collect())
        assert kept(L.read_log_files(spark, path)) == kept(L.prepare_logs(rows, now)), name
        for f in (tmp_path / name).rglob("*.parquet"):
            times = pq.ParquetFile(f).read(["timestamp"])["timestamp"].to_pylist()
            assert times == sorted(times)
    assert exchanged[:3] == [False, True, True]


@pytest.mark.parametrize("step", [40_000, 3600, 1, 0])
def test_far_pages_equal_skipping_row_by_row(spark, step):
    rng = random.Random(step)
    rows = log_rows(spark, 900, step).withColumn("timestamp", F.when(F.col("id").cast("int") % 50 != 7, F.col("timestamp")))
    whole = [r["id"] for r in rows.orderBy(F.desc("timestamp"), F.desc("id")).collect()]
    cached = rows.cache()
    for page in {1, 2, 18, 45, 46, 90, *[rng.randint(1, 90) for _ in range(3)]}:
        got = [r["id"] for r in A.page_logs(cached, page, 10, near=15).collect()]
        assert got == whole[10 * page - 10:10 * page], page
    assert A.page_logs(cached, 91, 10, near=15).count() == 0
    some = A.page_logs(cached, 30, 10, LogFilters(url_search="com/3"), near=15).collect()
    assert some == [] and A.page_logs(cached.limit(0), 30, 10, near=15).count() == 0
    cached.unpersist()


def test_a_far_page_sorts_few_rows(spark, tmp_path):
    path = str(tmp_path / "logs")
    L.append_logs(log_rows(spark, 3000, 600), path)
    rows, skip = A._jump(L.read_log_files(spark, path), 2000, 10, 50)
    assert skip <= 50 and rows.count() <= 150
    days = rows.select("log_date").distinct().count()
    assert days <= 2 and "log_date" in rows._jdf.queryExecution().optimizedPlan().toString()


# broken runs


def test_a_broken_removal_is_finished_by_the_next_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    L.append_logs(log_rows(spark, 72), path)
    day = L.days_of(spark, path)[1]
    only = L.read_log_files(spark, path).filter(F.col("log_date") == day).select("id").collect()
    for r in only[1:]:
        assert L.delete_log_at(spark, path, r["id"])
    real = L._drop

    def breaks(target):
        if "_stage_" not in target:
            raise OSError("lost")
        return real(target)

    monkeypatch.setattr(L, "_drop", breaks)
    with pytest.raises(OSError):
        L.delete_log_at(spark, path, only[0]["id"])  # the day is left empty, and its folder cannot be removed
    monkeypatch.setattr(L, "_drop", real)
    assert L.delete_log_at(spark, path, only[0]["id"]) and not L.delete_log_at(spark, path, only[0]["id"])
    assert day not in L.days_of(spark, path) or not L.parts_of(spark, path).count((day, -1))
    assert L.read_log_files(spark, path).count() == 72 - len(only)
    # retention breaks after the day of the cutoff was rewritten, before older days went
    monkeypatch.setattr(L, "_drop", breaks)
    as_of = datetime(2023, 12, 16, 12, tzinfo=UTC)
    kept = L.read_log_files(spark, path).filter(F.col("timestamp") >= F.lit(datetime(2023, 11, 16, 12, tzinfo=UTC))).count()
    with pytest.raises(OSError):
        L.delete_old_logs_at(spark, path, as_of, 30)
    monkeypatch.setattr(L, "_drop", real)
    L.delete_old_logs_at(spark, path, as_of, 30)
    assert L.read_log_files(spark, path).count() == kept and L.delete_old_logs_at(spark, path, as_of, 30) == 0
    assert not [p for p in tmp_path.iterdir() if "_stage_" in p.name]


def test_a_batch_lists_its_own_days_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    for batch in range(3):
        L.write_batch(log_rows(spark, 40).drop("id"), path, batch, now=datetime(2024, 1, 1, tzinfo=UTC))
    listed = []
    real = L._folders
    monkeypatch.setattr(L, "_folders", lambda p, c: listed.append(p) or real(p, c))
    L.write_batch(log_rows(spark, 1).drop("id"), path, 3)
    assert not [p for p in listed if p == path or p.startswith(f"{path}/")]
    monkeypatch.setattr(L, "_folders", real)
    assert L.read_log_files(spark, path).count() == 121
    # broken after the rows were written on another day: the same batch again leaves one copy
    untimed = log_rows(spark, 5).drop("id", "timestamp")
    L.write_batch(untimed, path, 4, now=datetime(2024, 3, 1, tzinfo=UTC))
    monkeypatch.setattr(L, "_drop", lambda p: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        L.write_batch(untimed, path, 4, now=datetime(2024, 3, 2, tzinfo=UTC))
    monkeypatch.undo()
    L.write_batch(untimed, path, 4, now=datetime(2024, 3, 3, tzinfo=UTC))
    own = L.read_log_files(spark, path).filter("batch_id = 4").collect()
    assert len(own) == 5 and {r["log_date"] for r in own} == {date(2024, 3, 3)}


# postings by batch


def test_postings_by_batch_equal_a_full_rebuild(spark, tmp_path):
    path, rng, table = str(tmp_path / "postings"), random.Random(3), {}
    columns = "id string, url string, markdown_content string, log_date date"

    def frame(rows):
        return spark.createDataFrame([(i, *v) for i, v in rows.items()], columns)

    def check():
        built = J.build_postings(frame(table))
        stored = PO.read_postings(spark, path).select(*built.columns)
        assert sorted(map(repr, stored.collect())) == sorted(map(repr, built.collect()))

    def row():
        return ("https://e.com/" + rng.choice("abc"), " ".join(rng.choice(["red", "green", "blue", "Été"]) for _ in range(rng.randint(0, 6))),
                date(2024, 1, rng.randint(1, 3)))

    new = {str(k): row() for k in range(12)}
    table |= new
    PO.add_postings(frame(new), path, 0)
    check()
    one = {"100": row()}
    table |= one
    before = PO.postings_parts(spark, path)
    PO.follow_logs(path)(frame(one), 1)
    after = PO.postings_parts(spark, path)
    assert sum(map(len, after.values())) == sum(map(len, before.values())) + 1  # nothing else was written
    changed = {k: row() for k in ("1", "5", "100")}
    table |= changed
    PO.add_postings(frame(changed), path, 2, replaces=True)
    PO.add_postings(frame(changed), path, 2, replaces=True)  # again
    check()
    for k in ("2", "3"):
        del table[k]
    PO.remove_postings(spark.createDataFrame([("2",), ("3",), (None,)], "id string"), path, 3)
    check()
    assert PO.merge_postings(spark, path) > 0
    check()
    assert all(len(b) == 1 for b in PO.postings_parts(spark, path).values()) and PO.merge_postings(spark, path) == 0
    back = {"2": row(), "200": row()}
    table |= back
    PO.add_postings(frame(back), path, 4)
    table["5"] = row()
    PO.add_postings(frame({"5": table["5"]}), path, 5, replaces=True)
    check()
    hits = {r["id"] for r in J.search_postings(PO.read_postings(spark, path), J.Terms(all_of=("red",))).collect()}
    assert hits == {k for k, v in table.items() if "red" in v[1].split()}
    PO.merge_postings(spark, path)
    check()


def test_a_broken_merge_reads_as_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "postings")
    rows = log_rows(spark, 30, 7200).withColumn("log_date", F.to_date("timestamp"))
    PO.add_postings(rows.filter("cast(id as int) < 20"), path, 0)
    PO.add_postings(rows.filter("cast(id as int) >= 15"), path, 1, replaces=True)
    want = sorted(map(repr, J.build_postings(rows).collect()))
    read = lambda: sorted(map(repr, PO.read_postings(spark, path).select("field", "term", "id", "log_date", "positions").collect()))
    assert read() == want
    real = PO._drop

    def breaks(target):
        if "batch_id" in target:
            raise OSError("lost")
        return real(target)

    monkeypatch.setattr(PO, "_drop", breaks)
    with pytest.raises(OSError):
        PO.merge_postings(spark, path)
    assert read() == want
    monkeypatch.setattr(PO, "_drop", real)
    PO.merge_postings(spark, path)
    assert read() == want and all(len(b) == 1 for b in PO.postings_parts(spark, path).values())


# the daily stream


def test_rows_of_closed_days_are_recounted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(times):
        df = spark.createDataFrame([(t, "success") for t in times], "t string, status string")
        df.select(F.col("t").cast("timestamp").alias("timestamp"), "status").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("timestamp timestamp, status string").parquet(source)
        query = stream_daily_stats(stream, out, checkpoint, open_for="2 days")
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: p, query.recentProgress) if p["stateOperators"]]

    def stats():
        return [(str(r["date"]), r["count"], r["success"]) for r in read_daily_stats(spark, out).orderBy("date").collect()]

    run(["2024-01-01 01:00", "2024-01-02 10:00", "2024-01-03 00:00"])
    states = run(["2024-01-02 05:00", "2024-01-20 00:00", "2024-01-21 00:00"])
    assert stats()[:3] == [("2024-01-01", 1, 1), ("2024-01-02", 2, 2), ("2024-01-03", 1, 1)]
    assert states[-1] <= 3  # closed days have left the state
    run(["2024-01-01 09:00", None])  # late: its day is closed
    assert stats()[0] == ("2024-01-01", 1, 1) and len(stats()) == 5
    recount_days(spark.read.parquet(source), out, [date(2024, 1, 1)])
    assert stats()[0] == ("2024-01-01", 2, 2) and len(stats()) == 5
    assert len(list((tmp_path / "out").glob("date=*"))) == 5


# use cases


def test_changes_across_hours(spark):
    rng = random.Random(5)
    rows = [(str(k), f"u{rng.randrange(3)}", 1_700_000_000 + rng.randrange(40) * 900, rng.choice(["a", "b", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, url string, t long, content_hash string").withColumn("timestamp", F.timestamp_seconds("t"))
    want, last = [], {}
    for i, url, t, h in sorted((r for r in rows if r[3]), key=lambda r: (r[2], r[0])):
        if last.get(url, h) != h:
            want.append((url, t, i, last[url], h))
        last[url] = h
    got = U.content_changes(df)
    assert sorted((r["url"], int(r["timestamp"].timestamp()), r["id"], r["previous_hash"], r["content_hash"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # read once


def test_headings_have_parents_without_an_exchange(spark):
    rng = random.Random(6)
    levels = [rng.randint(1, 6) for _ in range(400)]
    df = spark.createDataFrame([(1, "\n".join("#" * n + f" h{k}" for k, n in enumerate(levels))), (2, "none"), (3, None)], "doc_id int, markdown string")
    found = U.heading_structure(df)
    got = {r["ordinal"]: r["parent"] for r in found.collect()}
    assert got == {k: max((j for j in range(k) if levels[j] < n), default=None) for k, n in enumerate(levels)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
