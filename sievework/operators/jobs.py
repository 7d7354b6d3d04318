"""Table operators on jobs, records, outbox events and overlays.

Changes to tables are rewrites by join: an update batch gives the new table
and, where the change is guarded, the rows that conflicted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Legal state changes, fixed values.
TRANSITIONS = {
    "QUEUED": ("RUNNING", "CANCELLED", "DEAD_LETTERED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "CANCELLED"),
    "SUCCEEDED": ("DELETED",),
    "FAILED": ("QUEUED", "DEAD_LETTERED", "DELETED"),
    "CANCELLED": ("DELETED",),
    "DEAD_LETTERED": ("DELETED",),
    "DELETED": (),
}
RETENTION_DAYS = 30
STALE_SECONDS = 3600
MAX_RETRIES, ERROR_CHARS = 3, 500


def may_become(state: Column, target: Column) -> Column:
    legal = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    return F.concat_ws(">", state, target).isin(legal)


def page(table: DataFrame, order: list[Column], limit: int, offset: int = 0, state: str | None = None) -> DataFrame:
    """One page of a listing; the order must be total."""
    if state is not None:
        table = table.where(F.col("state") == state)
    return table.orderBy(*order).offset(offset).limit(limit)


def by_key(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of some keys: a point read of one, or a batch of them. keys: (column)."""
    return table.join(keys.select(column).distinct(), column, "left_semi")


def first_of_key(table: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row for each value of a key that should be unique: the first in the order."""
    rest = [c for c in table.columns if c != column]
    kept = table.where(F.col(column).isNotNull()).groupBy(column).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return kept.select(column, "first.*")


def stale(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Running jobs without a recent heartbeat."""
    cutoff = now - F.expr(f"INTERVAL {seconds} SECONDS")
    return jobs.where((F.col("state") == "RUNNING") & (F.col("last_heartbeat_at").isNull() | (F.col("last_heartbeat_at") < cutoff)))


def expired(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Soft-deleted jobs older than their own retention, else the default."""
    kept = F.make_dt_interval(F.coalesce("retention_days", F.lit(days)))
    return jobs.where(now - F.col("deleted_at") >= kept)


def purged(jobs: DataFrame, children: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the expired jobs and their children."""
    gone = expired(jobs, now).select("job_id")
    return jobs.join(gone, "job_id", "left_anti"), children.join(gone, "job_id", "left_anti")


def updated_states(jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """jobs after a batch of (job_id, target, expected_version), with `outcome`.

    An update applies if the version is the expected one and the change is
    legal; it raises the version. Everything else leaves the row alone.
    """
    joined = jobs.join(batch, "job_id", "left")
    outcome = (
        F.when(F.col("target").isNull(), "untouched")
        .when(F.col("version") != F.col("expected_version"), "conflict")
        .when(~may_become(F.col("state"), F.col("target")), "illegal")
        .otherwise("updated")
    )
    hit = F.col("outcome") == "updated"
    return joined.withColumn("outcome", outcome).select(
        *[c for c in jobs.columns if c not in ("state", "version")],
        F.when(hit, F.col("target")).otherwise(F.col("state")).alias("state"),
        (F.col("version") + F.when(hit, 1).otherwise(0)).alias("version"),
        "outcome",
    )


def reaped(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """jobs after stale running ones have failed, by the guarded update, with `outcome`."""
    late = stale(jobs, now, seconds)
    return updated_states(jobs, late.select("job_id", F.lit("FAILED").alias("target"), F.col("version").alias("expected_version")))


def soft_deleted(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """jobs after some (job_id) are marked as deleted, which ended ones alone can be, with `outcome`."""
    asked = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi").select("job_id", F.lit("DELETED").alias("target"), F.col("version").alias("expected_version"))
    done = updated_states(jobs, asked)
    return done.withColumn("deleted_at", F.when(F.col("outcome") == "updated", now).otherwise(F.col("deleted_at")))


def retried_states(jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """updated_states() where a conflict is tried once more with the version as it is now."""
    first = updated_states(jobs, batch)
    again = first.where("outcome = 'conflict'").select("job_id", F.col("version").alias("expected_version")).join(batch.select("job_id", "target"), "job_id")
    second = updated_states(first.drop("outcome"), again).withColumnRenamed("outcome", "second")
    return second.join(first.select("job_id", "outcome"), "job_id").withColumn("outcome", F.when(F.col("second") == "untouched", F.col("outcome")).otherwise(F.col("second"))).drop("second")


def keyset_pages(records: DataFrame, limit: int) -> DataFrame:
    """Every record with its page, page's cursor and whether more follow; pages
    run by (created_at, record_id) within a job."""
    order = Window.partitionBy("job_id").orderBy("created_at", "record_id")
    number = F.row_number().over(order) - 1
    everything = Window.partitionBy("job_id")
    total = F.count("*").over(everything)
    cursor = F.concat_ws("|", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), "record_id")
    numbered = records.withColumn("number", number).withColumn("total", total).withColumn("cursor", cursor)
    return numbered.withColumn("page", F.floor(F.col("number") / limit)).withColumn(
        "has_more", (F.col("page") + 1) * limit < F.col("total")
    )


def decode_cursor(cursor: Column) -> Column:
    """Struct (created_at, record_id); an ill-formed cursor is an error."""
    parts = F.split(cursor, r"\|", 2)
    made = F.try_to_timestamp(parts[0], F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    sound = F.struct(made.alias("created_at"), F.get(parts, F.lit(1)).alias("record_id"))
    return F.when(made.isNotNull() & (F.size(parts) == 2), sound).otherwise(F.raise_error(F.concat(F.lit("bad cursor: "), cursor)))


def after_cursor(records: DataFrame, job_id: int, cursor: str | None, limit: int) -> DataFrame:
    """The next limit + 1 records of one job: the last tells whether more follow."""
    own = records.where(F.col("job_id") == job_id)
    if cursor:
        at = decode_cursor(F.lit(cursor))
        own = own.where(F.struct("created_at", "record_id") > F.struct(at["created_at"].alias("created_at"), at["record_id"].alias("record_id")))
    return own.orderBy("created_at", "record_id").limit(limit + 1)


def pending(outbox: DataFrame, now: Column, limit: int, delay_seconds: int) -> DataFrame:
    """Undelivered events that were not tried just now, oldest first."""
    cutoff = now - F.expr(f"INTERVAL {delay_seconds} SECONDS")
    ready = outbox.where((F.col("status") == "PENDING") & (F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") < cutoff)))
    return ready.orderBy("created_at", "event_id").limit(limit)


def after_delivery(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """The outbox after (event_id, delivered, error): failures count retries, the last one fails the event."""
    retries = F.col("retry_count") + F.when(F.col("delivered") == F.lit(False), 1).otherwise(0)
    status = F.when(F.col("delivered"), "DELIVERED").when(F.col("retries") >= MAX_RETRIES, "FAILED").otherwise(F.col("status"))
    return (
        outbox.join(results, "event_id", "left")
        .withColumn("retries", retries)
        .select(
            *[c for c in outbox.columns if c not in ("status", "retry_count", "last_error")],
            status.alias("status"), F.col("retries").alias("retry_count"), F.substring("error", 1, ERROR_CHARS).alias("last_error"),
        )
    )


def upserted(stored: DataFrame, incoming: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """stored with incoming rows in place of those of equal key; columns of
    `kept` keep their stored value."""
    old, new = stored.alias("old"), incoming.alias("new")
    pick = lambda c: (
        F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in kept else F.when(F.col(f"new.{key}").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    )
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    return joined.select(F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}")).alias(key), *[pick(c).alias(c) for c in stored.columns if c != key])


def inserted_if_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"))


def patched(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """table with the given fields of the update batch; a null field leaves the stored value."""
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in updates.columns if c != key])
    pick = lambda c: F.coalesce(f"new_{c}", c).alias(c) if c in updates.columns and c != key else F.col(c)
    return table.join(new, key, "left").select(*[pick(c) for c in table.columns])


def promoted(overlays: DataFrame, chosen: DataFrame) -> DataFrame:
    """overlays after the chosen ones (overlay_id) go one step up: a candidate to
    shadow, a shadow to active, which retires the domain's active one and is
    remembered as the way back."""
    marked = overlays.join(chosen.select("overlay_id", F.lit(True).alias("chosen")), "overlay_id", "left")
    rising = marked.where("chosen and state = 'SHADOW'").groupBy("domain").agg(F.max("overlay_id").alias("riser"))
    active = overlays.where("state = 'ACTIVE'").groupBy("domain").agg(F.max("overlay_id").alias("was_active"))
    joined = marked.join(rising, "domain", "left").join(active, "domain", "left")
    rises = F.col("overlay_id") == F.col("riser")
    state = (
        F.when(F.coalesce(rises, F.lit(False)), "ACTIVE")
        .when(F.col("chosen") & (F.col("state") == "CANDIDATE"), "SHADOW")
        .when((F.col("state") == "ACTIVE") & F.col("riser").isNotNull(), "ROLLED_BACK")
        .otherwise(F.col("state"))
    )
    back = F.when(F.coalesce(rises, F.lit(False)), F.col("was_active")).otherwise(F.col("rollback_id"))
    return joined.select("overlay_id", "domain", state.alias("state"), back.alias("rollback_id"))
