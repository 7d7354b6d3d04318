"""Queries on strategy observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation as ev
from ..sources.tables import AS_OF, OBSERVATIONS_SQL, STRATEGIES, as_of, load, observations
from .registry import query

METRICS_SQL = f"""
{OBSERVATIONS_SQL}, m AS (
  SELECT domain, strategy, count(*) AS n, avg(CASE WHEN valid_record_count > 0 THEN 1.0 ELSE 0.0 END) AS p,
         avg(required_field_completeness) AS c, avg(latency_ms) AS l, avg(cost) AS k,
         avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS b
  FROM obs GROUP BY 1, 2
), s AS (
  SELECT *, 0.5 * p + 0.2 * c + 0.15 * greatest(0.0, least(1.0, 1 - l / 10000)) + 0.15 * (1 - b) AS score FROM m
)
"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {METRICS_SQL}
SELECT domain, strategy, n, round(p, 6) AS precision, round(c, 6) AS completeness, round(l, 6) AS latency,
       round(k, 6) AS cost, round(b, 6) AS block_rate, round(score, 6) AS score FROM s""")
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ev.scored(ev.metrics(observations(spark, sf_dir), "domain", "strategy"))
    return _rounded(table, "precision", "completeness", "latency", "cost", "block_rate", "score")


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, observation_id DESC) AS rank FROM obs
), k AS (SELECT domain, strategy, list_sort(list(latency_ms)) AS v FROM r WHERE rank <= 500 GROUP BY 1, 2)
SELECT domain, strategy, len(v) AS n, round(v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1], 6) AS p50,
       round(v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1], 6) AS p95 FROM k""")
def strategy_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = ev.newest(observations(spark, sf_dir), "domain", "created_at", "observation_id")
    values = F.collect_list("latency_ms")
    return recent.groupBy("domain", "strategy").agg(
        F.count("*").alias("n"),
        F.round(ev.at_share(values, 0.5), 6).alias("p50"),
        F.round(ev.at_share(values, 0.95), 6).alias("p95"),
    )


@query(f"""WITH {METRICS_SQL}, b AS (SELECT domain, score AS base FROM s WHERE strategy = 'http')
SELECT s.domain, strategy, n, round(score, 6) AS score, round(coalesce(base, score), 6) AS baseline_score,
       CASE WHEN score > 1.1 * coalesce(base, score) THEN 'promote' WHEN score < 0.9 * coalesce(base, score) THEN 'demote' ELSE 'no_change' END AS recommendation
FROM s LEFT JOIN b ON s.domain = b.domain WHERE n >= 5 AND strategy <> 'http'""")
def strategy_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ev.scored(ev.metrics(observations(spark, sf_dir), "domain", "strategy"))
    out = ev.recommendations(table, "http")
    return _rounded(out, "score", "baseline_score").select("domain", "strategy", "n", "score", "baseline_score", "recommendation")


@query(f"""WITH {METRICS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, list_position(['overlay', 'json_ld', 'semantic_html'], strategy)) AS place
  FROM s WHERE n >= 5 AND strategy IN ('overlay', 'json_ld', 'semantic_html'))
SELECT domain, strategy, n, round(score, 6) AS score FROM r WHERE place = 1""")
def best_strategy_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ev.scored(ev.metrics(observations(spark, sf_dir), "domain", "strategy"))
    return _rounded(ev.best_in(table, STRATEGIES[2:]), "score").select("domain", "strategy", "n", "score")


@query(f"""WITH {OBSERVATIONS_SQL}, d AS (SELECT DISTINCT domain FROM obs),
r AS (SELECT domain, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS s, avg(latency_ms) AS l, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS b, count(*) AS n
      FROM obs WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1)
SELECT d.domain, coalesce(n, 0) AS n, round(coalesce(s, 0.0), 6) AS success_rate, round(coalesce(l, 0.0), 6) AS mean_latency, round(coalesce(b, 0.0), 6) AS block_rate
FROM d LEFT JOIN r ON d.domain = r.domain""")
def domain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all domains from the last day; without evidence they stay at their defaults."""
    table = observations(spark, sf_dir)
    recent = table.where(F.col("created_at") >= as_of() - F.expr("INTERVAL 24 HOURS"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    fresh = recent.groupBy("domain").agg(
        F.count("*").alias("n"), share(F.col("success")).alias("success_rate"), F.avg("latency_ms").alias("mean_latency"), share(F.col("blocked")).alias("block_rate")
    )
    joined = table.select("domain").distinct().join(fresh, "domain", "left").fillna(0)
    return _rounded(joined, "success_rate", "mean_latency", "block_rate")


@query(f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT * FROM obs ORDER BY created_at DESC, observation_id DESC LIMIT 5000)
SELECT domain, count(*) AS n FROM n GROUP BY 1 HAVING count(*) >= 10""")
def domains_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = observations(spark, sf_dir).orderBy(F.col("created_at").desc(), F.col("observation_id").desc()).limit(5000)
    return recent.groupBy("domain").agg(F.count("*").alias("n")).where("n >= 10")


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, observation_id DESC) AS rank FROM obs)
SELECT domain, observation_id, strategy, rank FROM r WHERE rank <= 500 AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR""")
def recent_observations_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time filter comes after the cap of the newest rows."""
    recent = ev.newest(observations(spark, sf_dir), "domain", "created_at", "observation_id")
    recent = recent.where(F.col("created_at") >= as_of() - F.expr("INTERVAL 168 HOURS"))
    return recent.select("domain", "observation_id", "strategy", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {OBSERVATIONS_SQL}, m AS (
  SELECT domain, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS b, sum(cost) / (30 * 24) * 100 AS c FROM obs GROUP BY 1
), v AS (
  SELECT domain, 'extraction_success_rate' AS name, s AS value FROM m UNION ALL SELECT domain, 'block_rate', b FROM m UNION ALL SELECT domain, 'ai_cost_per_hour', c FROM m)
SELECT domain, name, round(value, 6) AS value, severity, CASE severity WHEN 'critical' THEN critical ELSE warning END AS threshold FROM (
  SELECT v.*, warning, critical,
    CASE WHEN worse AND value >= critical OR NOT worse AND value <= critical THEN 'critical' WHEN worse AND value >= warning OR NOT worse AND value <= warning THEN 'warning' END AS severity
  FROM v JOIN (VALUES ('extraction_success_rate', 0.85::DOUBLE, 0.70::DOUBLE, false), ('block_rate', 0.10, 0.25, true), ('ai_cost_per_hour', 100.0, 500.0, true)) AS t(name, warning, critical, worse) ON v.name = t.name)
WHERE severity IS NOT NULL""")
def slo_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    table = observations(spark, sf_dir).groupBy("domain").agg(
        share(F.col("success")).alias("extraction_success_rate"), share(F.col("blocked")).alias("block_rate"), (F.sum("cost") / (30 * 24) * 100).alias("ai_cost_per_hour")
    )
    values = table.unpivot("domain", ["extraction_success_rate", "block_rate", "ai_cost_per_hour"], "name", "value")
    return _rounded(ev.alerts(values), "value").select("domain", "name", "value", "severity", "threshold")


@query(f"""WITH {OBSERVATIONS_SQL}, a AS (SELECT 'd' || (p_partkey % 9) AS domain, max(p_partkey) AS overlay FROM part WHERE p_size > 10 GROUP BY 1),
o AS (SELECT domain, count(*) AS n, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS r FROM obs WHERE strategy = 'overlay' GROUP BY 1)
SELECT o.domain, overlay, n, round(r, 6) AS success_rate FROM o JOIN a ON o.domain = a.domain WHERE n >= 20 AND r < 0.6""")
def rollback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains whose active overlay does badly on enough evidence."""
    active = load(spark, sf_dir, "part").where("p_size > 10").groupBy(F.concat(F.lit("d"), F.col("p_partkey") % 9).alias("domain"))
    active = active.agg(F.max("p_partkey").alias("overlay"))
    rate = F.avg(F.when(F.col("success"), 1.0).otherwise(0.0))
    seen = observations(spark, sf_dir).where("strategy = 'overlay'").groupBy("domain").agg(F.count("*").alias("n"), rate.alias("success_rate"))
    return _rounded(seen.where("n >= 20 and success_rate < 0.6").join(active, "domain"), "success_rate").select("domain", "overlay", "n", "success_rate")


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, observation_id DESC) AS k FROM obs)
SELECT domain, overlay_id, count(*) AS n, count(*) >= 20 AS enough FROM r WHERE k <= 100 GROUP BY 1, 2""")
def promotion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = ev.newest(observations(spark, sf_dir), "domain", "created_at", "observation_id", 100)
    return recent.groupBy("domain", "overlay_id").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 20)


@query(f"""WITH {OBSERVATIONS_SQL}, t AS (
  SELECT domain, strategy, (sum(CASE WHEN success THEN 1 ELSE 0 END) + 1) / CAST(count(*) + 2 AS DOUBLE) * CASE WHEN avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) > 0.2 THEN 0.1 ELSE 1.0 END AS mean
  FROM obs GROUP BY 1, 2), r AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY mean DESC, list_position(['http', 'browser', 'overlay', 'json_ld', 'semantic_html'], strategy)) AS k FROM t)
SELECT domain, strategy, round(mean, 6) AS mean FROM r WHERE k = 1""")
def bandit_exploit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = observations(spark, sf_dir).groupBy("domain", "strategy").agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes"), (F.avg(F.when(F.col("blocked"), 1.0).otherwise(0.0)) > 0.2).alias("blocked")
    )
    stats = stats.withColumn("position", F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy")))
    return _rounded(ev.exploit(stats, "http"), "mean")


@query(f"""WITH {OBSERVATIONS_SQL}
SELECT domain, count(*) AS n, round(least(greatest(max(latency_ms / 2), 100.0), 60000.0), 6) AS delay_ms FROM obs WHERE success GROUP BY 1""")
def throttle_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over successful fetches alone the fold of the throttle is a maximum, which needs no order."""
    table = observations(spark, sf_dir).where("success")
    return table.groupBy("domain").agg(
        F.count("*").alias("n"), F.round(F.least(F.greatest(F.max(F.col("latency_ms") / 2), F.lit(100.0)), F.lit(60_000.0)), 6).alias("delay_ms")
    )


@query(f"""WITH {OBSERVATIONS_SQL}, t AS (
  SELECT domain, greatest(latency_ms / 2, 100.0, CASE WHEN NOT success AND observation_id % 10 = 0 THEN 5000.0 ELSE 0.0 END) AS asked,
         sum(CASE WHEN NOT success AND observation_id % 10 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY created_at DESC, observation_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM obs)
SELECT domain, count(*) AS n, round(max(least(asked * pow(2.0, least(coalesce(later, 0), 60)), 60000.0)), 6) AS delay_ms FROM t GROUP BY 1""")
def throttle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The throttle with its doubling, over all fetches of a domain."""
    table = observations(spark, sf_dir).withColumn("retry_after_s", F.when(F.col("observation_id") % 10 == 0, 5.0))
    return _rounded(ev.throttled(table, "domain"), "delay_ms")


@query(f"""WITH {OBSERVATIONS_SQL}, h AS (
  SELECT job_id, observation_id, sum(CAST(CASE WHEN blocked THEN -1.0 WHEN success THEN 0.5 ELSE 0.0 END AS DOUBLE)) OVER w AS health, count(*) OVER w AS uses FROM obs
  WINDOW w AS (PARTITION BY job_id ORDER BY created_at, observation_id ROWS UNBOUNDED PRECEDING))
SELECT job_id, min(CASE WHEN health <= -3 OR uses >= 50 THEN uses END) AS retired_at_use, max(uses) AS uses, round(min(health), 6) AS lowest FROM h GROUP BY 1""")
def session_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running health of a session: minus one a block, plus a half a success; retired at -3 or 50 uses."""
    order = Window.partitionBy("job_id").orderBy("created_at", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("blocked"), -1.0).when(F.col("success"), 0.5).otherwise(0.0)
    table = observations(spark, sf_dir).withColumn("health", F.sum(delta).over(order)).withColumn("uses", F.count("*").over(order))
    retired = F.when((F.col("health") <= -3) | (F.col("uses") >= 50), F.col("uses"))
    return table.groupBy("job_id").agg(F.min(retired).alias("retired_at_use"), F.max("uses").alias("uses"), F.round(F.min("health"), 6).alias("lowest"))


@query(f"""WITH {OBSERVATIONS_SQL}, g AS (
  SELECT domain, job_id, success, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY created_at, observation_id ROWS UNBOUNDED PRECEDING) AS island FROM obs),
s AS (SELECT job_id, island, sum(CASE WHEN success THEN 0 ELSE 1 END) AS misses FROM g GROUP BY 1, 2)
SELECT job_id, max(misses) AS longest, count(CASE WHEN misses >= 3 THEN 1 END) AS demotions FROM s GROUP BY 1""")
def miss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of misses, and runs of three or more, which demote a fast path."""
    order = Window.partitionBy("job_id").orderBy("created_at", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    islands = observations(spark, sf_dir).withColumn("island", F.sum(F.col("success").cast("int")).over(order))
    runs = islands.groupBy("job_id", "island").agg(F.count_if(~F.col("success")).alias("misses"))
    return runs.groupBy("job_id").agg(F.max("misses").alias("longest"), F.count_if(F.col("misses") >= 3).alias("demotions"))


@query("""SELECT user_id AS key_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS used, CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 20 END AS quota,
       greatest(count(*) - CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 20 END, 0) AS rejected FROM events GROUP BY 1, 2, 4""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each key and day against the quota of its tier."""
    quota = F.when(F.col("user_id") % 3 == 0, 2).when(F.col("user_id") % 3 == 1, 5).otherwise(20)
    used = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), quota.alias("quota"))
    return used.agg(F.count("*").alias("used")).withColumn("rejected", F.greatest(F.col("used") - F.col("quota"), F.lit(0)))


@query("""WITH t AS (SELECT user_id, event_type, ts, event_id, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type FROM t WHERE before IS NULL OR ts - before > INTERVAL 24 HOUR""")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose key was not seen in the day before."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    table = load(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(order))
    return table.where(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL 24 HOURS"))).select("event_id", "user_id", "event_type")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id AS root_id, event_id, k FROM r WHERE k <= 10""")
def fanout_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten children of each root are granted."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    table = load(spark, sf_dir, "events").withColumn("k", rank).where("k <= 10")
    return table.select(F.col("user_id").alias("root_id"), "event_id", F.col("k").cast("long").alias("k"))
