"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty if alike, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connection(sf_dir).execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = sorted(set(got[1]) - set(want[1])), sorted(set(want[1]) - set(got[1]))
        return f"{name}: {len(got[1])} and {len(want[1])} rows; only here {a[:2]}, only in SQL {b[:2]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sqls, queries = entry.oracle_sql(), entry.queries()
    for name in sys.argv[2:] or sorted(queries):
        try:
            if name in sqls:
                print(compare(spark, sys.argv[1], name, queries[name], sqls[name]) or f"{name}: same")
            else:
                print(f"{name}: {queries[name](spark, sys.argv[1]).count()} rows")
        except Exception as e:
            print(f"{name}: FAILED {str(e)[:600]}")
