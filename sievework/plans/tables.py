"""Queries on job, record, outbox and overlay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import jobs as op
from ..operators.policies import overlay_faults
from ..operators.records import field_errors, integrity_fault
from ..operators.titles import clustered
from ..sources.tables import JOBS_SQL, as_of, jobs, load
from .registry import GREEDY_SQL, LIKE_SQL, query

#: A time inside the range of order dates, so that some rows are on either side.
NOW = "1997-01-01 00:00:00"
LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of jobs. Lines have no key: the number within the job orders all columns."""
    lines = load(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS[1:]))
    return lines.select(
        F.col("l_orderkey").alias("job_id"),
        F.concat_ws("-", F.col("l_orderkey"), number).alias("record_id"),
        F.col("l_shipdate").alias("created_at"),
        "l_quantity",
        "l_extendedprice",
    )


RECORDS_SQL = f"""
rec AS (SELECT l_orderkey AS job_id, l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_COLUMNS[1:])}) AS record_id,
        CAST(l_shipdate AS TIMESTAMP) AS created_at, l_quantity, l_extendedprice FROM lineitem)
"""


@query(f"WITH {JOBS_SQL} SELECT job_id, state, created_at FROM jobs WHERE state = 'RUNNING' ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 50")
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("created_at").desc(), F.col("job_id").desc()]
    return op.page(jobs(spark, sf_dir), order, 50, 50, "RUNNING").select("job_id", "state", "created_at")


@query(f"WITH {JOBS_SQL} SELECT job_id, last_heartbeat_at FROM jobs WHERE state = 'RUNNING' AND (last_heartbeat_at IS NULL OR last_heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND)")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stale(jobs(spark, sf_dir), as_of(NOW)).select("job_id", "last_heartbeat_at")


@query(f"WITH {JOBS_SQL} SELECT job_id, deleted_at, retention_days FROM jobs WHERE TIMESTAMP '{NOW}' - deleted_at >= to_days(coalesce(retention_days, 30))")
def expired_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.expired(jobs(spark, sf_dir), as_of(NOW)).select("job_id", "deleted_at", "retention_days")


@query(f"""WITH {JOBS_SQL}, gone AS (SELECT job_id FROM jobs WHERE TIMESTAMP '{NOW}' - deleted_at >= to_days(coalesce(retention_days, 30)))
SELECT l_orderkey AS job_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT job_id FROM gone) AND l_orderkey IN (SELECT job_id FROM jobs) GROUP BY 1""")
def purge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records left of the jobs left after the purge."""
    children = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    left, kept = op.purged(jobs(spark, sf_dir), children, as_of(NOW))
    return kept.join(left.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("n"))


@query(f"""WITH {JOBS_SQL}, b AS (SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'FAILED' ELSE 'RUNNING' END AS target, CASE WHEN job_id % 5 = 0 THEN 2 ELSE 1 END AS ev FROM jobs WHERE job_id % 2 = 0),
legal AS (SELECT * FROM (VALUES ('QUEUED', 'RUNNING'), ('RUNNING', 'SUCCEEDED'), ('RUNNING', 'FAILED')) AS t(f, t)),
r AS (SELECT j.*, b.target, CASE WHEN target IS NULL THEN 'untouched' WHEN ev <> version THEN 'conflict' WHEN l.f IS NULL THEN 'illegal' ELSE 'updated' END AS outcome
  FROM jobs j LEFT JOIN b ON j.job_id = b.job_id LEFT JOIN legal l ON l.f = j.state AND l.t = b.target)
SELECT job_id, CASE WHEN outcome = 'updated' THEN target ELSE state END AS state, version + CASE WHEN outcome = 'updated' THEN 1 ELSE 0 END AS version, outcome FROM r""")
def job_state_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, key = jobs(spark, sf_dir), F.col("job_id")
    target = F.when(key % 3 == 0, "SUCCEEDED").when(key % 3 == 1, "FAILED").otherwise("RUNNING")
    batch = table.where(key % 2 == 0).select("job_id", target.alias("target"), F.when(key % 5 == 0, 2).otherwise(1).alias("expected_version"))
    return op.updated_states(table, batch).select("job_id", "state", "version", "outcome")


@query(f"WITH {JOBS_SQL} SELECT job_id, state, version FROM jobs WHERE job_id IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def jobs_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("job_id"))
    return op.by_key(jobs(spark, sf_dir), keys, "job_id").select("job_id", "state", "version")


@query("SELECT o_custkey AS idempotency_key, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders GROUP BY 1")
def jobs_by_idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that each idempotency key stands for: the first that was given it."""
    table = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idempotency_key"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))
    return op.first_of_key(table, "idempotency_key", ["created_at", "job_id"]).select("idempotency_key", "job_id")


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN late THEN 'FAILED' ELSE state END AS state, version + CASE WHEN late THEN 1 ELSE 0 END AS version
FROM (SELECT *, coalesce(state = 'RUNNING' AND (last_heartbeat_at IS NULL OR last_heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND), false) AS late FROM jobs)""")
def reaped_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reaped(jobs(spark, sf_dir), as_of(NOW)).select("job_id", "state", "version")


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN hit THEN 'DELETED' ELSE state END AS state, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at
FROM (SELECT *, job_id % 2 = 0 AND state = 'SUCCEEDED' AS hit FROM jobs)""")
def soft_deleted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = jobs(spark, sf_dir)
    return op.soft_deleted(table, table.where("job_id % 2 = 0"), as_of(NOW)).select("job_id", "state", "deleted_at")


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN state = 'RUNNING' THEN 'FAILED' ELSE state END AS state, version + CASE WHEN state = 'RUNNING' THEN 1 ELSE 0 END AS version,
  CASE WHEN state = 'RUNNING' THEN 'updated' ELSE 'illegal' END AS outcome FROM jobs WHERE state IN ('RUNNING', 'SUCCEEDED')""")
def retried_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that expects another version of every second job: the second try gets it."""
    table = jobs(spark, sf_dir).where("state in ('RUNNING', 'SUCCEEDED')")
    batch = table.select("job_id", F.lit("FAILED").alias("target"), F.when(F.col("job_id") % 2 == 0, 7).otherwise(1).alias("expected_version"))
    return op.retried_states(table, batch).select("job_id", "state", "version", "outcome")


@query("SELECT l_orderkey AS job_id, l_linenumber AS attempt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) AS place FROM lineitem")
def attempts_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_shipdate").desc(), F.col("l_linenumber").desc(), "l_partkey", "l_suppkey")
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt"), F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT 'orders' AS name, count(*) AS n_rows, count(*) - count(CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END) AS null_deleted, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS running FROM orders""")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls of a column and rows of a state: what a copied table is verified by."""
    return jobs(spark, sf_dir).agg(
        F.lit("orders").alias("name"), F.count("*").alias("n_rows"), F.count_if(F.col("deleted_at").isNull()).alias("null_deleted"), F.count_if(F.col("state") == "RUNNING").alias("running")
    )


@query(f"""WITH {RECORDS_SQL}, n AS (SELECT job_id, record_id, created_at, row_number() OVER (PARTITION BY job_id ORDER BY created_at, record_id) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS total FROM rec)
SELECT job_id, record_id, k // 3 AS page, (k // 3 + 1) * 3 < total AS has_more, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '|' || record_id AS cursor FROM n""")
def records_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyset_pages(records(spark, sf_dir), 3).select("job_id", "record_id", "page", "has_more", "cursor")


@query("SELECT l_orderkey AS job_id, count(*) AS n_records FROM lineitem GROUP BY 1")
def records_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n_records"))


OUTBOX_SQL = """
outbox AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'P' THEN 'DELIVERED' ELSE 'PENDING' END AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 DAY END AS last_attempt_at, CAST(o_orderkey % 4 AS INTEGER) AS retry_count FROM orders)
"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        key.alias("event_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "DELIVERED").otherwise("PENDING").alias("status"),
        F.when(key % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("last_attempt_at"),
        (key % 4).cast("int").alias("retry_count"),
        F.lit(None).cast("string").alias("last_error"),
    )


@query(f"WITH {OUTBOX_SQL} SELECT event_id, created_at FROM outbox WHERE status = 'PENDING' AND (last_attempt_at IS NULL OR last_attempt_at < TIMESTAMP '{NOW}' - INTERVAL 60 SECOND) ORDER BY created_at, event_id LIMIT 200")
def pending_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of the relay; the limit is its batch size."""
    return op.pending(outbox(spark, sf_dir), as_of(NOW), 200, 60).select("event_id", "created_at")


@query(f"""WITH {OUTBOX_SQL}, r AS (SELECT event_id, event_id % 3 = 0 AS ok, repeat('e', 600) AS error FROM outbox WHERE status = 'PENDING'),
j AS (SELECT o.*, ok, error, retry_count + CASE WHEN ok = false THEN 1 ELSE 0 END AS n FROM outbox o LEFT JOIN r ON o.event_id = r.event_id)
SELECT event_id, CASE WHEN ok THEN 'DELIVERED' WHEN n >= 3 THEN 'FAILED' ELSE status END AS status, n AS retry_count, length(substr(error, 1, 500)) AS error_chars FROM j""")
def outbox_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = outbox(spark, sf_dir)
    results = box.where("status = 'PENDING'").select("event_id", (F.col("event_id") % 3 == 0).alias("delivered"), F.lit("e" * 600).alias("error"))
    return op.after_delivery(box, results).select("event_id", "status", "retry_count", F.length("last_error").alias("error_chars"))


@query("""WITH o AS (SELECT 'host' || (p_partkey % 40) AS domain, p_partkey AS overlay_id, p_size AS version FROM part WHERE p_partkey % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY version DESC, overlay_id DESC) AS k FROM o)
SELECT domain, overlay_id, version FROM r WHERE k = 1""")
def latest_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active overlay of the highest version of each domain."""
    active = load(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    newest = F.max(F.struct(F.col("p_size").alias("version"), F.col("p_partkey").alias("overlay_id"))).alias("top")
    return active.groupBy(F.concat(F.lit("host"), F.col("p_partkey") % 40).alias("domain")).agg(newest).select("domain", "top.overlay_id", "top.version")


@query("""SELECT 'orders' AS name, count(*) AS total, count(o_custkey) AS with_key, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM orders
UNION ALL SELECT 'customer', count(*), count(c_nationkey), sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT, (SELECT count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)) FROM customer""")
def table_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that two copies of a table must agree on."""

    def checked(name: str, key: str, done: str) -> DataFrame:
        table = load(spark, sf_dir, name)
        per_key = table.groupBy(key).agg(F.count("*").alias("n"), F.count(key).alias("k"), F.count_if(F.expr(done)).alias("d"))
        return per_key.agg(
            F.lit(name).alias("name"), F.sum("n").alias("total"), F.sum("k").alias("with_key"), F.sum("d").alias("done"), F.count_if(F.col("n") > 1).alias("repeated")
        )

    return checked("orders", "o_custkey", "o_orderstatus = 'F'").unionByName(checked("customer", "c_nationkey", "c_acctbal > 0"))


@query("""SELECT p_partkey AS row_id, len(list_filter([CASE WHEN p_name IS NULL THEN 'name is required' END, CASE WHEN TRY_CAST(regexp_replace(p_type, '[,€$]', '', 'g') AS DOUBLE) IS NULL THEN 'kind is not a number' END,
  CASE WHEN NOT regexp_matches(p_brand, '^https?://') THEN 'link is not a url' END], lambda x: x IS NOT NULL)) AS n_errors FROM part""")
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("name", "string", True, "p_name"), ("kind", "number", False, "p_type"), ("link", "url", False, "p_brand")]
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.size(field_errors(fields)).alias("n_errors"))


@query("""WITH o AS (SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN '€ ' || CAST(o_custkey AS VARCHAR) || ',000,000.5' WHEN 1 THEN '0' WHEN 2 THEN 'on request' END AS budget, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey * 1000000 + 0.5 ELSE 0 END AS amount,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS published, substr(CAST(o_orderdate AS VARCHAR), 1, CAST(o_custkey % 7 AS INTEGER)) AS deadline, o_orderpriority AS title FROM orders)
SELECT row_id, CASE WHEN budget <> '' AND budget <> 'on request' AND (amount <= 0 OR amount > 500000000) THEN 'budget' WHEN published IS NOT NULL AND deadline <> '' AND length(deadline) < 5 THEN 'deadline'
  WHEN length(title) < 10 OR NOT contains(title, ' ') THEN 'title' ELSE 'ok' END AS verdict FROM o""")
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sanity rule that a row breaks, on budgets, deadlines and titles made of orders."""
    key, number = F.col("o_orderkey"), F.col("o_custkey")
    budget = F.when(key % 4 == 0, F.concat(F.lit("€ "), number, F.lit(",000,000.5"))).when(key % 4 == 1, "0").when(key % 4 == 2, "on request")
    deadline = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), (number % 7).cast("int"))
    verdict = integrity_fault(budget, F.when(key % 3 != 0, "x"), deadline, F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select(key.alias("row_id"), verdict.alias("verdict"))


@query("""WITH v AS (SELECT p_partkey AS model_id, p_brand AS job, p_retailprice * 0.75 + p_size * 0.25 AS price, p_retailprice / (p_size + 1) AS intelligence FROM part WHERE p_size > 2 AND p_name NOT LIKE '%:latest'),
r AS (SELECT *, intelligence / price AS value, row_number() OVER (PARTITION BY job ORDER BY intelligence / price DESC, model_id) AS place FROM v WHERE price > 0)
SELECT job, model_id, round(value, 6) AS value, place FROM r WHERE place <= 8""")
def catalogue_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best models of each job by intelligence for the blended price."""
    price = F.col("p_retailprice") * 0.75 + F.col("p_size") * 0.25
    table = load(spark, sf_dir, "part").where("p_size > 2 and p_name not like '%:latest'").select(
        F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("job"), price.alias("price"), (F.col("p_retailprice") / (F.col("p_size") + 1)).alias("intelligence")
    )
    value = F.col("intelligence") / F.col("price")
    rank = F.row_number().over(Window.partitionBy("job").orderBy(value.desc(), "model_id"))
    return table.where("price > 0").withColumn("place", rank).where("place <= 8").select("job", "model_id", F.round(value, 6).alias("value"), F.col("place").cast("long").alias("place"))


@query("""WITH k AS (SELECT unnest(json_keys(props)) AS key, event_id FROM events) SELECT key, count(*) AS n, min(event_id) AS first_row FROM k GROUP BY 1""")
def key_union_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the keys of a dynamic column, with the row that brings each first."""
    keys = load(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min("event_id").alias("first_row"))


@query("""WITH a AS (SELECT c_custkey AS model, c_acctbal AS price FROM customer WHERE c_custkey % 19 <> 0), b AS (SELECT c_custkey AS model, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 1.05 ELSE c_acctbal END AS price FROM customer WHERE c_custkey % 17 <> 0)
SELECT coalesce(a.model, b.model) AS model, CASE WHEN a.model IS NULL THEN 'added' WHEN b.model IS NULL THEN 'removed' WHEN abs(b.price - a.price) > 0.01 * abs(a.price) THEN 'repriced' ELSE 'same' END AS change FROM a FULL JOIN b ON a.model = b.model""")
def catalogue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots of a price list."""
    rows = load(spark, sf_dir, "customer")
    key, price = F.col("c_custkey"), F.col("c_acctbal")
    old = rows.where(key % 19 != 0).select(key.alias("model"), price.alias("old_price"))
    new = rows.where(key % 17 != 0).select(key.alias("model"), F.when(key % 5 == 0, price * 1.05).otherwise(price).alias("new_price"))
    change = (
        F.when(F.col("old_price").isNull(), "added")
        .when(F.col("new_price").isNull(), "removed")
        .when(F.abs(F.col("new_price") - F.col("old_price")) > 0.01 * F.abs("old_price"), "repriced")
        .otherwise("same")
    )
    return old.join(new, "model", "full").select("model", change.alias("change"))


@query("""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 0.0 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT c.c_custkey, coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN u ON u.c_custkey = c.c_custkey""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after updates of some fields of some rows."""
    table = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.col("c_custkey")
    updates = table.where(key % 2 == 0).select(key, F.when(key % 4 == 0, "X").alias("c_mktsegment"), F.when(key % 6 == 0, 0.0).alias("c_acctbal"))
    return op.patched(table, updates, "c_custkey")


@query("""WITH o AS (SELECT p_partkey AS id, p_partkey // 5 AS d, CASE p_partkey % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SHADOW' WHEN 2 THEN 'CANDIDATE' ELSE 'ROLLED_BACK' END AS state, p_size % 3 = 0 AS chosen FROM part),
r AS (SELECT d, max(id) AS riser FROM o WHERE chosen AND state = 'SHADOW' GROUP BY 1), a AS (SELECT d, max(id) AS was FROM o WHERE state = 'ACTIVE' GROUP BY 1)
SELECT id AS overlay_id, o.d AS domain, CASE WHEN coalesce(id = riser, false) THEN 'ACTIVE' WHEN chosen AND state = 'CANDIDATE' THEN 'SHADOW' WHEN state = 'ACTIVE' AND riser IS NOT NULL THEN 'ROLLED_BACK' ELSE state END AS state,
  CASE WHEN coalesce(id = riser, false) THEN was END AS rollback_id FROM o LEFT JOIN r ON r.d = o.d LEFT JOIN a ON a.d = o.d""")
def overlay_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays after a batch of approvals."""
    key = F.col("p_partkey")
    state = F.when(key % 5 == 0, "ACTIVE").when(key % 5 == 1, "SHADOW").when(key % 5 == 2, "CANDIDATE").otherwise("ROLLED_BACK")
    table = load(spark, sf_dir, "part")
    overlays = table.select(key.alias("overlay_id"), F.floor(key / 5).alias("domain"), state.alias("state"), F.lit(None).cast("long").alias("rollback_id"))
    return op.promoted(overlays, table.where("p_size % 3 = 0").select(key.alias("overlay_id")))


@query("""WITH c AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) AS total FROM events GROUP BY 1)
SELECT CAST(day AS TIMESTAMP) AS day, total, round(100.0 * ok / total, 6) AS success_pct, total > 50 AND 100.0 * ok / total < 85 AS alert FROM c""")
def success_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily success percentages; an alert needs over fifty attempts and below 85 %."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    counted = load(spark, sf_dir, "events").groupBy(day).agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count("*").alias("total"))
    share = 100.0 * F.col("ok") / F.col("total")
    return counted.select("day", "total", F.round(share, 6).alias("success_pct"), ((F.col("total") > 50) & (share < 85)).alias("alert"))


@query("""SELECT p_partkey AS overlay_id, list_sort(list_filter(['name', 'price', 'url'], lambda x: NOT list_contains(m, x))) AS missing, list_sort(list_filter(m, lambda x: NOT list_contains(['name', 'price', 'url'], x))) AS extra
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['name', 'price', 'url'] WHEN 1 THEN ['name', 'colour'] ELSE ['url', 'a', 'b'] END AS m FROM part)""")
def overlay_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that overlays lack, and fields that their schema does not know."""
    names = lambda *xs: F.array(*map(F.lit, xs))
    key = F.col("p_partkey")
    mapped = F.when(key % 3 == 0, names("name", "price", "url")).when(key % 3 == 1, names("name", "colour")).otherwise(names("url", "a", "b"))
    table = load(spark, sf_dir, "part").select(key.alias("overlay_id"), overlay_faults(names("name", "price", "url"), mapped).alias("f"))
    return table.select("overlay_id", "f.missing", "f.extra")


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, lower(p_name) AS title, CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS buyer, p_size AS deadline,
  p_type || p_size || p_brand AS address, CASE WHEN p_size < 10 THEN p_brand || p_name END AS outer_id FROM part),
t AS (SELECT DISTINCT title FROM p), likes AS (SELECT a.title AS ta, b.title AS tb FROM t a JOIN t b ON {LIKE_SQL.format(a="a.title", b="b.title")}),
pairs AS (SELECT x.k AS later, y.k AS earlier, CASE WHEN y.address = x.address THEN 0 WHEN y.outer_id = x.outer_id THEN 1 WHEN y.buyer IS NOT DISTINCT FROM x.buyer THEN 2 ELSE 3 END AS kind
 FROM p x JOIN p y ON y.k < x.k LEFT JOIN likes l ON l.ta = x.title AND l.tb = y.title
 WHERE y.address = x.address OR y.outer_id = x.outer_id OR l.ta IS NOT NULL AND (y.buyer IS NOT DISTINCT FROM x.buyer OR y.buyer IS NULL AND y.deadline = x.deadline)),
e AS MATERIALIZED (SELECT later, list(earlier) AS before FROM pairs GROUP BY 1),
n AS (SELECT k, row_number() OVER (ORDER BY k) AS i, coalesce(before, []) AS before FROM p LEFT JOIN e ON later = k),
{GREEDY_SQL.format(key="k")},
kept AS (SELECT unnest(kept) AS k FROM g WHERE i = (SELECT max(i) FROM g)),
heads AS (SELECT later, arg_min(earlier, kind::BIGINT * 1000000000 + earlier) AS head FROM pairs WHERE earlier IN (SELECT k FROM kept) AND later NOT IN (SELECT k FROM kept) GROUP BY 1)
SELECT k AS p_partkey, coalesce(head, k) AS group_no FROM p LEFT JOIN heads ON later = k""")
def legacy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under the first kept one that they repeat: by address, outer id, or like names of a brand (one brand is
    taken as none, so that its parts meet all others of their size)."""
    table = load(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.expr("nullif(p_brand, 'Brand#7')").alias("buyer"), F.col("p_size").alias("deadline"),
        F.concat("p_type", F.col("p_size").cast("string"), "p_brand").alias("address"), F.when(F.col("p_size") < 10, F.concat("p_brand", "p_name")).alias("outer_id"),
    )
    return clustered(table, "p_partkey", "p_name", "buyer", "deadline", "address", "outer_id").select("p_partkey", "group_no")
