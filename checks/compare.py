"""Compare registered queries with their SQL twins: ``python -m checks.compare <sf_dir> [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if isinstance(v, float):
        return format(v, ".9g")
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main(argv: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    from checks.oracles import SQL
    from checks.queries import QUERIES

    sf_dir, only = argv[0], argv[1:]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, run in QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            mine = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in SQL:
                print(f"{name:36s} rows {sum(mine.values()):8d} {took:6.2f}s  (no twin)", flush=True)
                continue
            start = time.time()
            cur = con.execute(SQL[name])
            names = [d[0] for d in cur.description]
            other = rows_of(names, cur.fetchall())
            same = sorted(names) == sorted(df.columns) and mine == other
            print(f"{name:36s} rows {sum(mine.values()):8d} {took:6.2f}s  twin {time.time() - start:6.2f}s  {'ok' if same else 'DIFFERENT'}", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns), sorted(names), "rows", sum(mine.values()), sum(other.values()))
                for label, extra in (("spark", mine - other), ("sql", other - mine)):
                    for r in sorted(extra, key=repr)[:2]:
                        print("   only", label, len(extra), repr(r)[:700])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:36s} FAILED {type(e).__name__}: {str(e)[:500]}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
