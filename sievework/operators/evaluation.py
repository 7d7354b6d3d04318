"""Strategy evaluation: metrics, scores, profiles, alerts, and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_EVIDENCE = 5
NEWEST = 500

#: Service levels, fixed values: name, warning, critical, whether higher is worse.
SERVICE_LEVELS = (
    ("extraction_success_rate", 0.85, 0.70, False),
    ("queue_age_seconds", 300.0, 600.0, True),
    ("cache_hit_rate", 0.30, 0.10, False),
    ("dlq_growth_rate", 10.0, 50.0, True),
    ("block_rate", 0.10, 0.25, True),
    ("ai_cost_per_hour", 100.0, 500.0, True),
    ("llm_groundedness", 0.7, 0.5, False),
)


def metrics(observations: DataFrame, *keys: str) -> DataFrame:
    """Means by key: precision is the share of attempts with a valid record."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return observations.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(F.col("valid_record_count") > 0).alias("precision"),
        F.avg("required_field_completeness").alias("completeness"),
        F.avg("latency_ms").alias("latency"),
        F.avg("cost").alias("cost"),
        share(F.col("blocked")).alias("block_rate"),
    )


def score(precision: Column, completeness: Column, latency: Column, block_rate: Column) -> Column:
    """Weighted score of a strategy; latency counts from 10 seconds down."""
    speed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - latency / 10_000))
    return 0.5 * precision + 0.2 * completeness + 0.15 * speed + 0.15 * (1 - block_rate)


def scored(table: DataFrame) -> DataFrame:
    return table.withColumn("score", score(*map(F.col, ("precision", "completeness", "latency", "block_rate"))))


def newest(table: DataFrame, key: str, order: str, tie: str, n: int = NEWEST) -> DataFrame:
    """The newest n rows of each key, before any other filter.

    Spark keeps n rows a key in each task before the shuffle, so that no key
    is gathered whole.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return table.withColumn("rank", rank).where(F.col("rank") <= n)


def at_share(values: Column, share: float) -> Column:
    """The value at index floor(n * share) of the sorted values, of which there are NEWEST at most."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) * share).cast("int"))


def recommendations(candidates: DataFrame, baseline: str) -> DataFrame:
    """Each strategy of a domain against the baseline strategy there; without a
    baseline the candidate is compared with itself, so that nothing changes."""
    base = candidates.where(F.col("strategy") == baseline).select("domain", F.col("score").alias("baseline_score"))
    joined = candidates.join(base, "domain", "left").withColumn("baseline_score", F.coalesce("baseline_score", "score"))
    verdict = (
        F.when(F.col("score") > 1.1 * F.col("baseline_score"), "promote")
        .when(F.col("score") < 0.9 * F.col("baseline_score"), "demote")
        .otherwise("no_change")
    )
    return joined.where((F.col("n") >= LEAST_EVIDENCE) & (F.col("strategy") != baseline)).withColumn("recommendation", verdict)


def best_in(candidates: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """The best-scoring strategy of the vocabulary in each domain; the first listed wins ties."""
    place = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("strategy"))
    known = candidates.where((place > 0) & (F.col("n") >= LEAST_EVIDENCE)).withColumn("place", place)
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("score").desc(), "place"))
    return known.withColumn("rank", rank).where("rank = 1").drop("rank", "place")


def service_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SERVICE_LEVELS), "name string, warning double, critical double, higher_is_worse boolean")


def alerts(values: DataFrame) -> DataFrame:
    """(…, name, severity, threshold) for the named values that miss a service level."""
    levels = F.broadcast(service_levels(values.sparkSession))  # a fixed list
    misses = lambda bound: F.when(F.col("higher_is_worse"), F.col("value") >= bound).otherwise(F.col("value") <= bound)
    severity = F.when(misses(F.col("critical")), "critical").when(misses(F.col("warning")), "warning")
    return (
        values.join(levels, "name")
        .withColumn("severity", severity)
        .where(F.col("severity").isNotNull())
        .withColumn("threshold", F.when(F.col("severity") == "critical", F.col("critical")).otherwise(F.col("warning")))
        .drop("warning", "critical", "higher_is_worse")
    )


def exploit(stats: DataFrame, default: str) -> DataFrame:
    """The choice of each domain: highest mean of Beta(successes + 1, failures + 1),
    a tenth of it where blocked; the first strategy wins ties."""
    mean = (F.col("successes") + 1) / (F.col("attempts") + 2) * F.when(F.col("blocked"), 0.1).otherwise(1.0)
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("mean").desc(), "position"))
    chosen = stats.withColumn("mean", mean).withColumn("rank", rank).where("rank = 1")
    return chosen.select("domain", F.coalesce("strategy", F.lit(default)).alias("strategy"), "mean")


def next_delay(current: Column, latency: Column, ok: Column, retry_after_s: Column, floor: float, concurrency: int, most: float) -> Column:
    """One step of the fetch throttle; a delay never falls."""
    target = latency / concurrency if concurrency > 0 else latency
    damped = F.greatest((current + target) / 2, target)
    penalty = F.when(ok, 0.0).otherwise(F.coalesce(retry_after_s * 1000, current * 2))
    return F.least(F.greatest(damped, penalty, current, F.lit(floor)), F.lit(most))


def throttled(steps: DataFrame, key: str, floor: float = 100.0, concurrency: int = 2, most: float = 60_000.0) -> DataFrame:
    """The delay of each key after its observations, in their order.

    A step takes the delay d to min(most, max(c, d)), or where a failure
    doubles it to min(most, max(c, 2 d)): with m the larger of what latency,
    floor and a Retry-After ask for, damping never exceeds max(m, d). So the
    steps from one observation on multiply by two as often as fetches failed
    without a Retry-After, and the delay at the end is the largest of what each
    observation asks for, doubled by the failures after it, and cut at `most`.
    That is a count of later failures and a maximum: no key is gathered.
    Observations are ordered within hours, whose failures are counted first,
    so that a key's history is spread over as many places as it has hours.
    """
    target = F.greatest(F.col("latency_ms") / concurrency if concurrency > 0 else F.col("latency_ms"), F.lit(floor))
    asked = F.greatest(target, F.when(~F.col("success"), F.col("retry_after_s") * 1000).otherwise(0.0))
    doubles = (~F.col("success") & F.col("retry_after_s").isNull()).cast("int")
    rows = steps.select(key, "created_at", "observation_id", F.date_trunc("hour", "created_at").alias("hour"), asked.alias("asked"), doubles.alias("doubles"))
    hours = rows.groupBy(key, "hour").agg(F.sum("doubles").alias("doubled"))
    later_hours = Window.partitionBy(key).orderBy(F.col("hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("after", F.coalesce(F.sum("doubled").over(later_hours), F.lit(0))).drop("doubled")
    later = Window.partitionBy(key, "hour").orderBy(F.col("created_at").desc(), F.col("observation_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("doubles").over(later), F.lit(0)))
    power = F.pow(F.lit(2.0), F.least(F.col("own") + F.col("after"), F.lit(60)))
    delays = own.join(hours, [key, "hour"]).withColumn("delay", F.least(F.col("asked") * power, F.lit(most)))
    return delays.groupBy(key).agg(F.count("*").alias("n"), F.max("delay").alias("delay_ms"))
