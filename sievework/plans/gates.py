"""Queries of the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates
from ..sources.tables import load
from .registry import query


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_partkey AS overlay_id, CASE l_linenumber % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'SHADOW' ELSE 'retired' END AS target, l_quantity > 25 AS approved FROM lineitem),
o AS (SELECT p_partkey AS overlay_id, CASE p_partkey % 3 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'SHADOW' ELSE 'ROLLED_BACK' END AS state FROM part WHERE p_size > 5)
SELECT request_id, r.overlay_id, CASE WHEN state IS NULL THEN 'not_found' WHEN target = 'active' AND NOT approved THEN 'approval_required' WHEN state = 'CANDIDATE' AND target <> 'SHADOW' THEN 'only_to_shadow'
 WHEN state = 'SHADOW' AND target <> 'active' THEN 'only_to_active' ELSE 'ok' END AS verdict FROM r LEFT JOIN o ON o.overlay_id = r.overlay_id""")
def promotion_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of requests to promote overlays."""
    line, part = F.col("l_linenumber") % 3, F.col("p_partkey") % 3
    target = F.when(line == 0, "active").when(line == 1, "SHADOW").otherwise("retired")
    requests = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_partkey").alias("overlay_id"), target.alias("target"), (F.col("l_quantity") > 25).alias("approved")
    )
    state = F.when(part == 0, "CANDIDATE").when(part == 1, "SHADOW").otherwise("ROLLED_BACK")
    overlays = load(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("overlay_id"), state.alias("state"))
    return gates.promotion_verdicts(requests, overlays).drop("target")


@query("""WITH r AS (SELECT event_id AS request_id, user_id % 40 AS key_id, ts, CAST(ts AS DATE) AS day FROM events),
k AS (SELECT DISTINCT user_id % 40 AS key_id FROM events WHERE user_id % 40 <> 39), h AS (SELECT key_id, CASE key_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 20 ELSE 0 END AS most,
 CASE WHEN key_id % 5 = 0 THEN TIMESTAMP '2024-01-15 12:00:00' END AS ends FROM k),
v AS (SELECT r.*, most, h.key_id IS NULL AS unknown, coalesce(ends <= ts, false) AS expired FROM r LEFT JOIN h ON h.key_id = r.key_id),
n AS (SELECT *, row_number() OVER (PARTITION BY key_id, day, unknown OR expired ORDER BY ts, request_id) AS place FROM v)
SELECT request_id, key_id, day, CASE WHEN unknown THEN 'unknown_key' WHEN expired THEN 'expired' WHEN place > most THEN 'over_limit' ELSE 'ok' END AS verdict FROM n""")
def request_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests are served by their key's validity and the daily limit of its tier."""
    requests = load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 40).alias("key_id"), "ts")
    key = F.col("key_id")
    tier = F.when(key % 4 == 0, "free").when(key % 4 == 1, "basic").when(key % 4 == 2, "pro").otherwise("none")
    keys = requests.select("key_id").distinct().where("key_id <> 39")
    keys = keys.select("key_id", tier.alias("tier"), F.when(key % 5 == 0, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("expires_at"))
    return gates.admissions(requests, keys, {"free": 2, "basic": 5, "pro": 20})


@query("""WITH m AS (SELECT CASE p_partkey % 7 WHEN 0 THEN '~' ELSE '' END || 'm' || p_partkey || CASE p_partkey % 7 WHEN 1 THEN ':batch' ELSE '' END AS model_id, CASE WHEN p_size % 5 <> 0 THEN p_size END AS iq,
 p_size * 1000 AS context, p_partkey % 2 = 0 AS structured, 0.75 * CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_retailprice END + 0.25 * CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END AS price FROM part),
j AS (SELECT * FROM (VALUES ('extract', 32000, true), ('plan', 200000, false), ('judge', 8000, false)) AS t(job, asked, json)),
r AS (SELECT job, model_id, iq / price AS value, row_number() OVER (PARTITION BY job ORDER BY iq / price DESC, model_id)::INT AS place FROM m JOIN j ON context >= asked * 0.15 AND (NOT json OR structured)
 WHERE NOT starts_with(model_id, '~') AND NOT contains(model_id, ':batch') AND iq IS NOT NULL AND price > 0)
SELECT job, place, model_id, round(value, 6) AS value FROM r WHERE place <= 8""")
def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that each job may use, best value first, by all rules of the catalogue."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(key % 7 == 0, "~").otherwise(""), F.lit("m"), key, F.when(key % 7 == 1, ":batch").otherwise(""))
    priced = lambda c: F.when(key % 11 == 0, 0).otherwise(c)
    models = load(spark, sf_dir, "part").select(
        name.alias("model_id"), F.when(size % 5 != 0, size).alias("intelligence"), (size * 1000).alias("context_length"), (key % 2 == 0).alias("structured"),
        priced(F.col("p_retailprice")).alias("prompt_price"), priced(size).alias("completion_price"),
    )
    made = gates.model_ranking(models, (("extract", 32000, True), ("plan", 200000, False), ("judge", 8000, False)))
    return made.withColumn("value", F.round("value", 6))
