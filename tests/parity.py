"""Run registered queries in Spark and DuckDB and report differences."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """None when row sets agree exactly, else a short description."""
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    cols = sorted(got.columns)
    rows = []
    for f in (got, want):
        f = f[cols].astype(object).where(f[cols].notna(), None)
        rows.append(sorted((tuple(r) for r in f.itertuples(index=False)), key=repr))
    for c in cols:
        if (got[c].dtype.kind in "if") != (want[c].dtype.kind in "if"):
            return f"dtype of {c}: {got[c].dtype} != {want[c].dtype}"
    a, b = rows
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n  {cols}\n  {bad[0][0]}\n  {bad[0][1]}"
    return None if a else "no rows"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or qs:
        start = time.time()
        try:
            if name in sql:
                problem = difference(qs[name](spark, sf_dir), con, sql[name])
            else:
                n = qs[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(names or qs)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
