"""Small steps between the stages: answers, envelopes, cache entries, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_HITS = 10
CACHE_DAYS = 30
#: Records that an answer is written from.
SYNTHESIS_RECORDS = 200
#: Defaults of rows from the older store, fixed values.
OLD_DEFAULTS = {"source": "unknown", "title": "Untitled", "currency": "EUR", "status": "OPEN", "change_type": "NEW"}


def result_limit(requested: Column, fan_out: Column, most: int = MOST_HITS) -> Column:
    """How many hits to ask for: no more than can be used, one at least; a null fan-out is no bound."""
    return F.greatest(F.lit(1), F.least(F.lit(most), requested, F.coalesce(fan_out, F.lit(most))))


def tolerant_json(answer: Column) -> Column:
    """The JSON object in an answer, with or without a code fence; null for anything else."""
    bare = F.trim(F.regexp_replace(answer, r"```(?:json)?\s*|\s*```", ""))
    return F.when(F.try_parse_json(bare).isNotNull() & F.startswith(bare, F.lit("{")), bare)


def guessed_kind(name: Column) -> Column:
    """What a field's name says of its values."""
    low = F.lower(name)
    has = lambda *words: reduce_or([F.contains(low, F.lit(w)) for w in words])
    return F.when(has("price", "rating", "count"), "number").when(has("url", "link", "href"), "url").otherwise("string")


def reduce_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def tally(successes: DataFrame, keys: list[str]) -> DataFrame:
    """(combination, n, best): successes of each combination; best marks the most
    successful one, the first by name among equals."""
    counted = successes.groupBy(F.concat_ws("|", *keys).alias("combination")).agg(F.count("*").alias("n"))
    top = counted.agg(F.min_by("combination", F.struct((-F.col("n")).alias("n"), "combination")).alias("top"))
    return counted.join(F.broadcast(top)).select("combination", "n", (F.col("combination") == F.col("top")).alias("best"))  # one row


def first_records(records: DataFrame, most: int = SYNTHESIS_RECORDS) -> DataFrame:
    """The first records of each job, in the order its pages list them."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "record_id"))
    return records.withColumn("place", place).where(F.col("place") <= most)


def enveloped(messages: DataFrame, kind: str, root: Column, payload: list[str], message_id: Column | None = None) -> DataFrame:
    """(message_id, message_type, root_job_id, retry_count, payload): the rows as
    messages, the payload as JSON. A repeated run gives the same ids where message_id is given."""
    own = F.expr("uuid()") if message_id is None else message_id
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return messages.select(own.alias("message_id"), F.lit(kind).alias("message_type"), root.alias("root_job_id"), F.lit(0).alias("retry_count"), body.alias("payload"))


def from_old_store(rows: DataFrame) -> DataFrame:
    """Rows of the older store in today's shape: the URL is the key, defaults fill gaps."""
    filled = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in OLD_DEFAULTS.items() if c in rows.columns})
    return filled.withColumn("id", F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("id").cast("string")))


def enriched(records: DataFrame, answers: DataFrame, key: str, fields: dict[str, str], share: float = 0.05) -> DataFrame:
    """records with the fields that an answer fills overwritten, for a fixed share
    of the keys, drawn by hash. fields: record column to answer column; empty
    texts fill nothing."""
    asked = F.pmod(F.xxhash64(key), F.lit(10_000)) < share * 10_000
    given = answers.select(key, *[F.col(a).alias(f"new_{f}") for f, a in fields.items()])
    joined = records.join(given, key, "left").withColumn("enriched", asked)
    new = lambda f: F.when(asked & (F.col(f"new_{f}").cast("string") != ""), F.col(f"new_{f}"))
    return joined.withColumns({f: F.coalesce(new(f), F.col(f)) for f in fields}).drop(*[f"new_{f}" for f in fields])


def cache_after(cache: DataFrame, fetches: DataFrame) -> DataFrame:
    """The crawl cache after some fetches: (url, content_hash, etag, cached_at, expires_at, hits).

    The newest fetch of a URL replaces its entry; a fetch with status 304 only
    counts as a hit and refreshes the times. cache has the same columns.
    """
    newest = fetches.groupBy("url").agg(
        F.max("fetched_at").alias("seen_at"), F.count_if(F.col("status") == 304).alias("new_hits"),
        F.max_by(F.struct("content_hash", "etag"), F.when(F.col("status") == 200, F.col("fetched_at"))).alias("new"),
    )
    joined = cache.join(newest, "url", "full").where("new.content_hash is not null or content_hash is not null")
    at = F.coalesce("seen_at", "cached_at")
    return joined.select(
        "url", F.coalesce("new.content_hash", "content_hash").alias("content_hash"), F.coalesce("new.etag", F.when(F.col("new.content_hash").isNull(), F.col("etag"))).alias("etag"),
        at.alias("cached_at"), F.when(F.col("seen_at").isNotNull(), at + F.expr(f"INTERVAL {CACHE_DAYS} DAYS")).otherwise(F.col("expires_at")).alias("expires_at"),
        (F.coalesce("hits", F.lit(0)) + F.coalesce("new_hits", F.lit(0))).alias("hits"),
    )


def tier_after(tier: Column, ok: Column) -> Column:
    """A cheap fetch that fails sends its domain to the browser; nothing else changes a tier."""
    return F.when((tier == "http") & ~ok, "browser").otherwise(tier)


def copied(source: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, report): target with the rows of source written over it by key, and
    one row of counts: read, inserted, updated, total. A key given twice counts
    once; nothing is written, so that the report alone is a dry run."""
    last = source.dropDuplicates([key])
    counts = last.join(target.select(key, F.lit(True).alias("there")), key, "left").agg(
        F.count("*").alias("read"), F.count_if(F.col("there").isNull()).alias("inserted"), F.count_if("there").alias("updated")
    )
    total = target.agg(F.count("*").alias("before"))
    report = counts.join(F.broadcast(total)).select("read", "inserted", "updated", (F.col("before") + F.col("inserted")).alias("total"))  # one row
    return target.join(last.select(key), key, "left_anti").unionByName(last.select(*target.columns)), report


def flat_models(catalogue: DataFrame, body: str = "body") -> DataFrame:
    """One flat row a catalogue entry (JSON text): what the entry does not say is null."""
    v = F.try_parse_json(body)
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    supported = F.coalesce(at("$.supported_parameters", "array<string>"), F.array().cast("array<string>"))
    return catalogue.select(
        at("$.id").alias("id"), at("$.name").alias("name"), at("$.context_length", "long").alias("context_length"),
        at("$.pricing.prompt", "double").alias("prompt_price"), at("$.pricing.completion", "double").alias("completion_price"),
        supported.alias("supported_parameters"), F.array_contains(supported, "temperature").alias("supports_temperature"),
        F.array_contains(supported, "structured_outputs").alias("supports_structured_outputs"), F.array_contains(supported, "tools").alias("supports_tools"),
        at("$.architecture.input_modalities", "array<string>").alias("input_modalities"), at("$.reasoning.mandatory", "boolean").alias("reasoning_mandatory"),
    )


def pins(profiles: DataFrame) -> DataFrame:
    """(model, place): the distinct models of all chains, in the order they first
    come up. profiles: (profile_no, chain array<string>)."""
    rows = profiles.select("profile_no", F.posexplode("chain").alias("pos", "model"))
    first = rows.groupBy("model").agg(F.min(F.struct("profile_no", "pos")).alias("at"))
    return first.select("model", F.row_number().over(Window.orderBy("at")).alias("place"))  # a handful of models


def fallback(chain: Column, failed: Column) -> Column:
    """The first model of a chain that has not failed, null if all have."""
    return F.get(F.array_except(chain, failed), F.lit(0))
