"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python -m checks.compare SF_DIR [NAME ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def local_session(cpus: str = "8", app: str = "tollgate") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    con.execute(sql)
    names = [d[0] for d in con.description]
    expected = rows_of(names, con.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    actual = rows_of(spark_df.columns, spark_df.collect())
    if actual == expected:
        return None
    extra, missing = actual - expected, expected - actual
    return (
        f"{sorted(names)}: {actual.total()} rows vs {expected.total()}; only in Spark {list(extra)[:3]}; "
        f"only in SQL {list(missing)[:3]}"
    )


def main() -> int:
    from checks.catalog import QUERIES, SQL

    sf, *names = sys.argv[1:]
    spark, con, bad = local_session(), duck(sf), 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in SQL:
                result = difference(df, con, SQL[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += result != "ok" and not result.startswith("rows only")
        print(f"{name:28s} {time.time() - started:6.1f}s  {result[:1800]}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
