import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("webloam-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Run a column function over texts, in order."""
    def run(function, *columns):
        rows = [(i, *values) for i, values in enumerate(zip(*columns))]
        df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} string" for k in range(len(columns))))
        from pyspark.sql import functions as F
        out = df.select("i", function(*[F.col(f"c{k}") for k in range(len(columns))]).alias("v")).collect()
        return [r["v"] for r in sorted(out, key=lambda r: r["i"])]
    return run
