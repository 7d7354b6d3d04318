"""Registers queries together with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql gives the same rows in DuckDB."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Like titles in DuckDB: the longest common subsequence by bits of one number (titles up to 100 letters).
LIKE_SQL = """round(200.0 * (len({a}) - bit_count(list_reduce(list_prepend((1::HUGEINT << len({a})) - 1, list_transform(string_split({b}, ''),
 lambda c: coalesce(list_sum(list_transform(range(len({a})), lambda i: CASE WHEN substr({a}, i::INT + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)),
 lambda r, h: ((r + (r & h)) | (r & ~h)) & ((1::HUGEINT << len({a})) - 1)))) / (len({a}) + len({b}))) >= 90"""
#: In order, a row of n (i, key, before) is kept if none of those before it that it is like was.
GREEDY_SQL = """g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
 UNION ALL SELECT n.i, CASE WHEN list_has_any(n.before, g.kept) THEN g.kept ELSE list_append(g.kept, n.{key}) END FROM g JOIN n ON n.i = g.i + 1)"""
