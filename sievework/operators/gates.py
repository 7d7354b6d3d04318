"""Gates: who may promote an overlay, whose request is served, which models a job may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Share of the context a job asks for that a model must have, and prices as blended: fixed values.
LEAST_CONTEXT, BLEND_IN, BLEND_OUT = 0.15, 0.75, 0.25


def promotion_verdicts(requests: DataFrame, overlays: DataFrame) -> DataFrame:
    """requests (request_id, overlay_id, target, approved) with `verdict`: ok, or
    why not. Only a person's approval makes an overlay active; a candidate goes
    to shadow and a shadow to active, in one step each. overlays has one row an overlay_id."""
    target, state = F.upper("target"), F.col("held")
    verdict = (
        F.when(state.isNull(), "not_found")
        .when((target == "ACTIVE") & ~F.coalesce("approved", F.lit(False)), "approval_required")
        .when((state == "CANDIDATE") & ~F.coalesce(target == "SHADOW", F.lit(False)), "only_to_shadow")
        .when((state == "SHADOW") & ~F.coalesce(target == "ACTIVE", F.lit(False)), "only_to_active")
        .otherwise("ok")
    )
    joined = requests.join(overlays.select("overlay_id", F.col("state").alias("held")), "overlay_id", "left")
    return joined.select("request_id", "overlay_id", "target", verdict.alias("verdict"))


def tier_limit(tier: Column, limits: dict[str, int]) -> Column:
    """Requests a day that a tier may make; null for one that is not listed."""
    found = F.lit(None).cast("int")
    for name, most in limits.items():
        found = F.when(tier == name, most).otherwise(found)
    return found


def admissions(requests: DataFrame, keys: DataFrame, limits: dict[str, int]) -> DataFrame:
    """requests (request_id, key_id, ts) with `verdict`: ok, unknown_key,
    expired, or over_limit beyond the tier's requests of a day (UTC), in order of time.

    keys: (key_id, tier, expires_at), one row a key; a null expiry never ends; a
    tier without a limit serves none. Only the last request within the limit is
    looked for, among the first of each key and day, so that a key with
    however many requests is not ordered whole.
    """
    held = keys.select("key_id", tier_limit(F.col("tier"), limits).alias("most"), "expires_at", F.lit(True).alias("known"))
    joined = requests.select("request_id", "key_id", "ts", F.to_date("ts").alias("day")).join(held, "key_id", "left")
    expired = F.coalesce(F.col("expires_at") <= F.col("ts"), F.lit(False))
    valid = joined.where(F.col("known") & ~expired)
    place = F.row_number().over(Window.partitionBy("key_id", "day").orderBy("ts", "request_id"))
    first = valid.withColumn("place", place).where(F.col("place") <= max(limits.values(), default=0))
    last = first.where(F.col("place") == F.col("most")).select("key_id", "day", F.struct("ts", "request_id").alias("last"))
    over = F.coalesce(F.col("most"), F.lit(0)) <= 0
    over = over | F.coalesce(F.struct("ts", "request_id") > F.col("last"), F.lit(False))
    verdict = F.when(F.col("known").isNull(), "unknown_key").when(expired, "expired").when(over, "over_limit").otherwise("ok")
    return joined.join(last, ["key_id", "day"], "left").select("request_id", "key_id", "day", verdict.alias("verdict"))


def model_ranking(models: DataFrame, jobs: tuple[tuple[str, int, bool], ...], most: int = 8) -> DataFrame:
    """(job, place, model_id, value): the best models of each job by benchmarked
    intelligence for the blended price, ties by name.

    models: (model_id, intelligence, context_length, structured, prompt_price,
    completion_price); jobs: (job, context_length, expects_json). Floating
    aliases (~), batch tiers, models without a benchmark or a price, with too
    short a context, or without the structured output that a job expects, are left out.
    """
    price = BLEND_IN * F.col("prompt_price") + BLEND_OUT * F.col("completion_price")
    usable = models.where(~F.startswith("model_id", F.lit("~")) & ~F.contains("model_id", F.lit(":batch")) & F.col("intelligence").isNotNull()).withColumn("price", price).where("price > 0")
    asked = F.array(*(F.struct(F.lit(j).alias("job"), F.lit(c * LEAST_CONTEXT).alias("least"), F.lit(s).alias("json")) for j, c, s in jobs))
    fits = F.filter(asked, lambda j: (F.coalesce("context_length", F.lit(0)) >= j["least"]) & (~j["json"] | F.coalesce("structured", F.lit(False))))
    rows = usable.select("model_id", (F.col("intelligence") / F.col("price")).alias("value"), F.explode(fits).alias("j"))
    place = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("value"), "model_id"))
    return rows.select("model_id", "value", "j.job").withColumn("place", place).where(F.col("place") <= most).select("job", "place", "model_id", "value")
