"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and once timed, from building the DataFrame to the
last row, into a sink that drops the rows. The given tables are one file of one row group
each, which Spark reads in one task; before timing they are written anew as several files,
as tables of any size lie on a cluster. $BENCH_AS_GIVEN=1 leaves that out.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "d13_process_pages", "o1_run_batch", "d4_prune_dom", "d9_extract_main_content", "d8_scientific_preprocess",
    "d1_tokenize_html", "g6_link_image_counts", "n19_regex_clean", "n13_normalize_markdown_spacing", "l4_normalize_headings",
    "p3_assemble_pdf_markdown", "g1_log_stats", "g5_full_stats", "g2_daily_stats", "t1_page_logs", "t2_page_logs_keyset",
    "j1_search_logs", "j3_build_postings", "w2_resolve_attempts", "u1_keyword_density", "u4_content_changes", "s3_append_logs",
)


def in_several_files(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A copy of the tables, each in as many files as there are tasks to keep busy."""
    out = tempfile.mkdtemp(prefix="webloam-bench-")
    for name in sorted(n for n in os.listdir(sf_dir) if n.endswith(".parquet")):
        spark.read.parquet(os.path.join(sf_dir, name)).repartition(files).write.parquet(os.path.join(out, name))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("webloam-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    given, sf_dir = sf_dir, sf_dir if os.environ.get("BENCH_AS_GIVEN") else in_several_files(spark, sf_dir, 2 * int(cpus))
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet")).count()
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "pages_per_sec": round(pages / times["d13_process_pages"], 1), "log_rows_per_sec": round(events / times["g1_log_stats"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
