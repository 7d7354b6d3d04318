"""Tables of a scale folder, and views of them in the engine's own shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for every rule that depends on the time: a parameter, never the clock.
AS_OF = "2024-01-31 00:00:00"
STRATEGIES = ("http", "browser", "overlay", "json_ld", "semantic_html")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(literal: str = AS_OF) -> Column:
    return F.lit(literal).cast("timestamp_ntz")


def pick(values: tuple[str, ...], number: Column) -> Column:
    """The value at a position, counted from 0."""
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy observations: one row a fetch attempt."""
    success = F.col("event_type").isin("purchase", "signup", "view")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("observation_id"),
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("d"), F.col("user_id") % 5).alias("domain"),
        pick(STRATEGIES, F.col("event_id") % 5).alias("strategy"),
        F.concat(F.lit("o"), F.col("event_id") % 7).alias("overlay_id"),
        success.alias("success"),
        (F.col("event_type") == "error").alias("blocked"),
        success.cast("int").alias("valid_record_count"),
        F.least(F.col("value") / 300, F.lit(1.0)).alias("required_field_completeness"),
        (F.col("value") * 30).alias("latency_ms"),
        (F.col("value") / 1000).alias("cost"),
        F.col("ts").alias("created_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with state, heartbeat, soft deletion and retention."""
    key, made = F.col("o_orderkey"), F.col("o_orderdate")
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("QUEUED")
    after = lambda seconds: (made.cast("timestamp") + F.make_dt_interval(secs=seconds)).cast("timestamp_ntz")
    return load(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        state.alias("state"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        made.alias("created_at"),
        F.when(key % 11 != 0, after(F.col("o_custkey").cast("decimal(18,6)"))).alias("last_heartbeat_at"),
        F.when(key % 7 == 0, after(F.lit(30 * 86400).cast("decimal(18,6)"))).alias("deleted_at"),
        F.when(key % 3 == 0, (F.col("o_custkey") % 60).cast("int")).alias("retention_days"),
        F.lit(1).alias("version"),
    )


#: DuckDB forms of the views.
OBSERVATIONS_SQL = """
obs AS (
  SELECT event_id AS observation_id, user_id AS job_id, 'd' || (user_id % 5) AS domain,
         CASE event_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'browser' WHEN 2 THEN 'overlay' WHEN 3 THEN 'json_ld' ELSE 'semantic_html' END AS strategy,
         'o' || (event_id % 7) AS overlay_id, event_type IN ('purchase', 'signup', 'view') AS success,
         event_type = 'error' AS blocked, CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 1 ELSE 0 END AS valid_record_count,
         least(value / 300, 1.0) AS required_field_completeness, value * 30 AS latency_ms, value / 1000 AS cost, ts AS created_at
  FROM events
)
"""
JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED' ELSE 'QUEUED' END AS state,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(o_orderdate AS TIMESTAMP) AS created_at,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_custkey) END AS last_heartbeat_at,
         CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END AS deleted_at,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 60 AS INTEGER) END AS retention_days, 1 AS version
  FROM orders
)
"""
