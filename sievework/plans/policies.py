"""Queries on fetch, cache, discovery and promotion decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web
from ..functions.html import small_batches
from ..operators import policies as op
from ..sources.tables import OBSERVATIONS_SQL, STRATEGIES, as_of, load, observations, pick
from .registry import query

NOW = "1998-01-01 00:00:00"


@query("""WITH c AS (SELECT o_orderkey AS url_id, o_orderkey % 31 = 0 AS force, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CASE WHEN o_orderkey % 3 = 0 THEN 3000 ELSE 0 END) END AS made,
  CASE o_orderkey % 4 WHEN 0 THEN 304 WHEN 1 THEN 200 WHEN 2 THEN 200 ELSE 500 END AS status, o_orderkey % 4 = 1 AS same FROM orders),
d AS (SELECT *, CASE WHEN force THEN 'forced' WHEN made IS NULL THEN 'not cached' WHEN TIMESTAMP '1998-01-01 00:00:00' - made < INTERVAL 24 HOUR THEN 'fresh' WHEN status = 304 THEN 'not modified'
  WHEN status = 200 AND same THEN 'same etag' WHEN status = 200 THEN 'changed' ELSE 'unexpected answer' END AS reason FROM c)
SELECT url_id, reason, reason NOT IN ('fresh', 'not modified', 'same etag') AS fetch FROM d""")
def cache_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    later = F.when(key % 3 == 0, 3000).otherwise(0)
    at = F.when(key % 5 != 0, F.col("o_orderdate") + F.make_dt_interval(later))
    status = F.when(key % 4 == 0, 304).when(key % 4 < 3, 200).otherwise(500)
    made = op.cache_decision(key % 31 == 0, at, as_of(NOW), F.lit("a"), status, F.when(key % 4 == 1, "a").otherwise("b"))
    return load(spark, sf_dir, "orders").select(key.alias("url_id"), made.alias("d")).select("url_id", "d.reason", "d.fetch")


@query("""WITH h AS (SELECT page_id, page_id % 7 AS plan_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https', 'http') AS canon FROM pages),
m AS (SELECT *, row_number() OVER (PARTITION BY plan_id, host ORDER BY page_id) > 1 AS rep FROM h),
r AS (SELECT *, CASE WHEN rep THEN 'duplicate' WHEN contains(host, 'spam') THEN 'policy_denied' WHEN page_id % 11 = 0 THEN 'ssrf_blocked' WHEN page_id % 5 = 0 THEN 'cache_fresh' END AS reason FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY plan_id, reason IS NULL ORDER BY page_id) AS k FROM r)
SELECT plan_id, coalesce(reason, CASE WHEN k > 5 THEN 'fanout_budget_exceeded' ELSE 'task' END) AS reason, count(*) AS n FROM g GROUP BY 1, 2""")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of search hits: tasks, or the first rule that rejects them; hits of one host count as the same."""
    hits = load(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("plan_id"), F.col("page_id").alias("rank"), "url")
    host, key = web.authority(F.col("url")), F.col("rank")
    done = op.discovered(hits, host, F.contains(host, F.lit("spam")), key % 11 == 0, key % 5 == 0, 5)
    return done.groupBy("plan_id", F.coalesce("reason", F.lit("task")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT 'd' || (l_orderkey % 50) AS domain, CASE WHEN l_linenumber % 2 = 0 THEN 'candidate' ELSE 'active' END AS role, l_quantity > 10 AS filled FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber % 2 = 0),
c AS (SELECT domain, count(*) FILTER (WHERE role = 'candidate') AS c, count(*) FILTER (WHERE role = 'active') AS a, count(*) FILTER (WHERE role = 'candidate' AND filled) AS f FROM r GROUP BY 1), s AS (SELECT 'd' || (o_orderkey % 50) AS domain, count(*) AS n FROM orders GROUP BY 1)
SELECT c.domain, round(c / n, 6) AS precision, round(f / c, 6) AS completeness, CASE WHEN c / n - a / n > 0.1 THEN 'promote' WHEN c / n - a / n < -0.1 THEN 'demote' ELSE 'no_change' END AS recommendation FROM c JOIN s ON c.domain = s.domain WHERE c > 0""")
def shadow_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    outputs = load(spark, sf_dir, "lineitem").where((F.col("l_orderkey") % 4 != 0) | even).select(
        F.concat(F.lit("d"), F.col("l_orderkey") % 50).alias("domain"), F.when(even, "candidate").otherwise("active").alias("role"), (F.col("l_quantity") > 10).alias("filled")
    )
    samples = load(spark, sf_dir, "orders").groupBy(F.concat(F.lit("d"), F.col("o_orderkey") % 50).alias("domain")).agg(F.count("*").alias("n"))
    made = op.shadow_verdicts(outputs, samples)
    return made.select("domain", F.round("precision", 6).alias("precision"), F.round("completeness", 6).alias("completeness"), "recommendation")


@query(f"""WITH {OBSERVATIONS_SQL}, t AS (SELECT 'u' || job_id AS domain, strategy, count(*) AS n, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) > 0.3 AS b FROM obs WHERE strategy <> 'http' GROUP BY 1, 2),
w AS (SELECT *, list_position(['http', 'browser', 'overlay', 'json_ld', 'semantic_html'], strategy) AS k, greatest(0.01, (CASE WHEN n < 10 THEN greatest(1.0, 10 - n) ELSE 1.0 END) * (CASE WHEN b THEN 0.1 ELSE 1.0 END))::DOUBLE AS w FROM t),
u AS (SELECT *, sum(w) OVER (PARTITION BY domain ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY domain) AS total, CAST('0x' || substr(md5(domain), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS draw FROM w)
SELECT domain, arg_min(strategy, upto) AS strategy FROM u WHERE upto >= draw * total GROUP BY 1""")
def bandit_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted draw among the less tried strategies of each user's domain."""
    stats = observations(spark, sf_dir).groupBy(F.concat(F.lit("u"), F.col("job_id")).alias("domain"), "strategy").agg(
        F.count("*").alias("attempts"), (F.avg(F.when(F.col("blocked"), 1.0).otherwise(0.0)) > 0.3).alias("blocked")
    )
    stats = stats.withColumn("position", F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy")))
    draw = F.conv(F.substring(F.md5("domain"), 1, 7), 16, 10).cast("double") / float(1 << 28)
    return op.explored(stats, "http", draw)


@query("""WITH v AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS VARCHAR) WHEN 1 THEN '-5' WHEN 2 THEN 'Wed, 31 Jan 2024 00:01:00 GMT' ELSE 'soon' END AS v FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 100)::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 60.0 END AS wait_s FROM v""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    value = F.when(key % 4 == 0, (key % 100).cast("string")).when(key % 4 == 1, "-5").when(key % 4 == 2, "Wed, 31 Jan 2024 00:01:00 GMT").otherwise("soon")
    return load(spark, sf_dir, "events").select("event_id", op.retry_after_seconds(value, as_of()).alias("wait_s"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN TIMESTAMP '2000-01-01 00:00:00' WHEN 2 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS at FROM events""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, ts = F.col("event_id"), F.col("ts")
    value = (
        F.when(key % 4 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".0+02:00"))).when(key % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key % 4 == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise("yesterday")
    )
    return load(spark, sf_dir, "events").select("event_id", op.parsed_time(value, as_of("2000-01-01 00:00:00")).alias("at"))


@query("""WITH i AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '10.0.0.' || (event_id % 200) WHEN 1 THEN '8.8.' || (event_id % 200) || '.8' WHEN 2 THEN '::ffff:127.0.0.1' WHEN 3 THEN '100.64.0.1' ELSE 'host' END AS ip FROM events)
SELECT event_id, event_id % 5 <> 1 AS private FROM i""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    ip = F.when(key % 5 == 0, F.concat(F.lit("10.0.0."), key % 200)).when(key % 5 == 1, F.concat(F.lit("8.8."), key % 200, F.lit(".8"))).when(key % 5 == 2, "::ffff:127.0.0.1").when(key % 5 == 3, "100.64.0.1").otherwise("host")
    return load(spark, sf_dir, "events").select("event_id", op.private_ip(ip).alias("private"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id AS job_id, md5(string_agg('<record id="' || turn || '">' || chr(10) || left(text, 1500) || chr(10) || '</record>', chr(10) ORDER BY k)) AS prompt_md5 FROM r WHERE k <= 40 GROUP BY 1""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record blocks of each conversation's prompt."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").cast("string").alias("record_id"), F.col("turn").alias("created_at"), "text")
    made = op.prompt_records(rows, tx.safe_prompt(F.substring("text", 1, op.PROMPT_CHARS)))
    return made.select("job_id", F.md5("prompt_records").alias("prompt_md5"))


@query("""WITH f AS (SELECT user_id AS root, 'u' || (event_id % 40) AS url FROM events WHERE event_type = 'view'), s AS (SELECT user_id AS root, 'u' || (event_id % 40) AS url FROM events WHERE event_type = 'click')
SELECT DISTINCT root, url FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.root = f.root AND s.url = f.url)""")
def unseen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.concat(F.lit("u"), F.col("event_id") % 40).alias("url"), "event_type")
    return op.unseen(rows.where("event_type = 'view'").select("root", "url"), rows.where("event_type = 'click'"))


@query("SELECT event_id, substr(sha256('p|' || event_type || '|' || props), 1, 16) AS cache_key, CASE WHEN event_id % 3 = 0 THEN 'browser' ELSE 'http' END AS tier, CASE WHEN event_id % 3 = 1 THEN 'json_ld' END AS extractor FROM events")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached answers, and mixed preferences split in two."""
    axes = op.profile_axes(pick(("browser", "json_ld", "http"), F.col("event_id") % 3))
    key = F.substring(F.sha2(F.concat_ws("|", F.lit("p"), "event_type", "props"), 256), 1, 16)
    return load(spark, sf_dir, "events").select("event_id", key.alias("cache_key"), axes.alias("a")).select("event_id", "cache_key", "a.tier", "a.extractor")


@query()
def prompt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made visible-only and small, with their sizes."""
    small_batches(spark)
    small = op.compact_html(op.visible_html(F.col("html")))
    return load(spark, sf_dir, "pages").select("page_id", F.length("html").alias("before"), F.length(small).alias("after"))


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'id:' || event_id ELSE user_id || '|None|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE rtrim(strftime(ts, '.%f'), '0') END || '|' || coalesce(CAST(props AS VARCHAR), 'None') END AS k FROM events WHERE event_type = 'error'),
h AS (SELECT event_id, sha1(unhex('{op.DEAD_LETTERS.hex}') || encode(k)) AS x FROM e)
SELECT event_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(x, 17, 1) AS INTEGER) % 4) + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS dead_letter_id FROM h""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of failed events, with and without a key of their own."""
    table = load(spark, sf_dir, "events").where("event_type = 'error'")
    own = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    return table.select("event_id", op.dead_letter_id(own, F.col("user_id"), F.lit(None), F.col("ts"), F.col("props")).alias("dead_letter_id"))
