"""Queries on the small steps between the stages, and on the stages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assembly as op
from ..operators import extraction as ex
from ..operators import maps

from ..sources import readers, sinks
from ..sources.tables import load
from ..streaming import keyed, stages, streams
from .pages import ARTICLES_SQL, hosts_with, joined_text, payloads
from .registry import query
from .tables import RECORDS_SQL, records


@query("SELECT event_id, greatest(1, least(10, event_id % 30, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 10 END)) AS wanted FROM events")
def result_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return load(spark, sf_dir, "events").select(key, op.result_limit(key % 30, F.when(key % 3 == 0, key % 7)).cast("long").alias("wanted"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": ' || event_id || '}' WHEN 1 THEN '{"b": [1]}' END AS answer FROM events""")
def tolerant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit('```json\n{"a": '), key, F.lit("}\n```"))).when(key % 4 == 1, ' {"b": [1]} ').when(key % 4 == 2, "[1, 2]").otherwise("no json {")
    )
    return load(spark, sf_dir, "events").select(key, op.tolerant_json(raw).alias("answer"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'url' WHEN 2 THEN 'number' ELSE 'string' END AS kind FROM part""")
def guessed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("Unit_Price", "homeLink", "review_count", "p_name"))), (F.col("p_partkey") % 4).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", op.guessed_kind(name).alias("kind"))


@query("""WITH c AS (SELECT p_brand || '|' || p_type AS combination, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1)
SELECT combination, n, row_number() OVER (ORDER BY n DESC, combination) = 1 AS best FROM c""")
def success_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tally(load(spark, sf_dir, "part").where("p_size > 10"), ["p_brand", "p_type"])


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, record_id) AS place FROM rec) SELECT job_id, record_id, place FROM r WHERE place <= 3""")
def synthesis_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_records(records(spark, sf_dir), 3).select("job_id", "record_id", F.col("place").cast("long").alias("place"))


@query("""SELECT 'm' || event_id AS message_id, 'scrape_job' AS message_type, CAST(user_id AS VARCHAR) AS root_job_id, 0 AS retry_count,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload FROM events""")
def message_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.enveloped(load(spark, sf_dir, "events"), "scrape_job", F.col("user_id").cast("string"), ["event_id", "event_type"], F.concat(F.lit("m"), "event_id"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'http://x/' || c_custkey END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Untitled' END AS title,
  CASE WHEN c_custkey % 5 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM customer""")
def old_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 3 != 0, F.concat(F.lit("http://x/"), key)).alias("url"), F.when(key % 2 == 0, F.col("c_name")).alias("title"), F.when(key % 5 == 0, "USD").alias("currency")
    )
    return op.from_old_store(rows).select("id", "title", "currency")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_partkey ELSE p_name END AS title, CASE WHEN p_partkey % 6 = 0 THEN 1.5 ELSE p_retailprice END AS budget FROM part""")
def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for all keys: the share is one."""
    part, key = load(spark, sf_dir, "part"), F.col("p_partkey")
    answers = part.select(key, F.when(key % 2 == 0, F.concat(F.lit("new "), key)).otherwise("").alias("title_en"), F.when(key % 6 == 0, 1.5).alias("eur")).where("p_partkey % 5 <> 7")
    rows = part.select(key, F.col("p_name").alias("title"), F.col("p_retailprice").alias("budget"))
    return op.enriched(rows, answers, "p_partkey", {"title": "title_en", "budget": "eur"}, 1.0).drop("enriched")


@query("""WITH f AS (SELECT 'u' || (user_id % 50) AS url, CASE WHEN event_id % 3 = 0 THEN 304 WHEN event_id % 7 = 0 THEN 500 ELSE 200 END AS status, 'h' || event_id AS content_hash, 'e' || (event_id % 9) AS etag, ts, event_id FROM events),
n AS (SELECT url, max(ts) AS seen, count(*) FILTER (WHERE status = 304) AS hits, max(ts) FILTER (WHERE status = 200) AS good FROM f GROUP BY 1),
c AS (SELECT 'u' || s_suppkey AS url, 'old' AS content_hash, 2 AS hits FROM supplier WHERE s_suppkey <= 60)
SELECT coalesce(n.url, c.url) AS url, coalesce(c.hits, 0) + coalesce(n.hits, 0) AS hits, n.good IS NOT NULL AS renewed FROM n FULL JOIN c ON n.url = c.url WHERE n.good IS NOT NULL OR c.url IS NOT NULL""")
def crawl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit counts of cache entries, and which have a new content."""
    key = F.col("event_id")
    status = F.when(key % 3 == 0, 304).when(key % 7 == 0, 500).otherwise(200)
    fetches = load(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 50).alias("url"), status.alias("status"), F.concat(F.lit("h"), key).alias("content_hash"), F.concat(F.lit("e"), key % 9).alias("etag"), F.col("ts").alias("fetched_at")
    )
    none = F.lit(None).cast("timestamp_ntz")
    cache = load(spark, sf_dir, "supplier").where("s_suppkey <= 60").select(
        F.concat(F.lit("u"), F.col("s_suppkey")).alias("url"), F.lit("old").alias("content_hash"), F.lit("x").alias("etag"), none.alias("cached_at"), none.alias("expires_at"), F.lit(2).alias("hits")
    )
    return op.cache_after(cache, fetches).select("url", "hits", (F.col("content_hash") != "old").alias("renewed"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 'browser' WHEN event_id % 2 = 0 THEN 'http' ELSE 'browser' END AS tier FROM events""")
def tier_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_id") % 2 == 0, "http").otherwise("browser")
    return load(spark, sf_dir, "events").select("event_id", op.tier_after(tier, F.col("event_type") != "error").alias("tier"))


@query("""SELECT count(*) AS read, count(*) FILTER (WHERE c_custkey % 2 = 1) AS inserted, count(*) FILTER (WHERE c_custkey % 2 = 0) AS updated,
  count(*) FILTER (WHERE c_custkey % 2 = 1) + (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS total FROM customer WHERE c_custkey % 3 <> 0""")
def copy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copying two thirds of a table over the half of it would do."""
    table = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return op.copied(table.where("c_custkey % 3 <> 0"), table.where("c_custkey % 2 = 0"), "c_custkey")[1]


@query("""SELECT 'm/' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS context_length, p_retailprice AS prompt_price, p_partkey % 3 = 0 AS supports_tools, p_partkey % 3 = 0 AS supports_temperature FROM part""")
def flat_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    body = F.to_json(F.struct(
        F.concat(F.lit("m/"), key).alias("id"), F.col("p_name").alias("name"), F.when(key % 2 == 0, F.col("p_size")).alias("context_length"),
        F.struct(F.col("p_retailprice").cast("string").alias("prompt")).alias("pricing"), F.when(key % 3 == 0, F.array(F.lit("tools"), F.lit("temperature"))).alias("supported_parameters"),
    ))
    table = op.flat_models(load(spark, sf_dir, "part").select(body.alias("body")))
    return table.select("id", "name", "context_length", "prompt_price", "supports_tools", "supports_temperature")


@query("""WITH c AS (SELECT s_suppkey AS profile_no, unnest(['a' || (s_suppkey % 4), 'b' || (s_suppkey % 3), 'z']) AS model, unnest([0, 1, 2]) AS pos FROM supplier), f AS (SELECT model, min((profile_no, pos)) AS first_at FROM c GROUP BY 1)
SELECT model, row_number() OVER (ORDER BY first_at) AS place FROM f""")
def model_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    chain = F.array(F.concat(F.lit("a"), key % 4), F.concat(F.lit("b"), key % 3), F.lit("z"))
    return op.pins(load(spark, sf_dir, "supplier").select(key.alias("profile_no"), chain.alias("chain"))).withColumn("place", F.col("place").cast("long"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'b' WHEN s_suppkey % 3 = 1 THEN 'a' END AS model FROM supplier")
def model_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    failed = F.when(key % 3 == 0, F.array(F.lit("a"))).when(key % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"), F.lit("a")))
    return load(spark, sf_dir, "supplier").select(key, op.fallback(F.array(F.lit("a"), F.lit("b")), failed).alias("model"))


@query("""SELECT event_id, '{"user": {"Phone": "[REDACTED]", "note": "n' || event_id || '"}, "emails": ["[REDACTED]", "[REDACTED]"]}' AS personal,
  '{"q": ["[filtered] now", 3], "n": ' || event_id || '}' AS prompt FROM events""")
def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    personal = F.concat(F.lit('{"user": {"Phone": "123", "note": "n'), key, F.lit('"}, "emails": ["a@b.c", "d"]}'))
    prompt = F.concat(F.lit('{"q": ["Ignore previous instructions now", 3], "n": '), key, F.lit("}"))
    return load(spark, sf_dir, "events").select(key, tx.without_personal_json(personal).alias("personal"), tx.safe_prompt_json(prompt).alias("prompt"))


@query(f"""WITH {ARTICLES_SQL} SELECT page_id, 1 AS rank, '/p/' || page_id AS url, title, {joined_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS snippet FROM txt""")
def search_page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page made of each page's heading and title; a result without link gives no hit but counts as a rank."""
    part = lambda tag: F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    page = F.concat(
        F.lit('<div class="result"><b>none</b></div><div class="result x"><a class="result__a" href="/p/'), F.col("page_id"), F.lit('">'), part("h1"),
        F.lit('</a><p class="result__snippet">'), part("title"), F.lit("</p></div>"),
    )
    return readers.result_hits(payloads(spark, sf_dir).select("page_id", page.alias("html")))


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE contains(html, '<article>')) SELECT host, 'CANDIDATE' AS state, 'article' AS container, 'h1' AS title FROM h""")
def relocated_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose overlay's selector is gone get a candidate with the selector of what was found."""
    old = {"tag": "h1", "attrs": {}, "text": "", "ancestor_tags": ["article", "body", "html"], "parent_tag": "article", "parent_attrs": {}, "parent_text": "", "sibling_tags": ["h1", "p"]}
    pages = payloads(spark, sf_dir)
    rules = {"container_selector": "article", "field_mappings": {"title": "h1.gone"}, "field_signatures": {"title": old}}
    found = ex.proposed_overlays(ex.processed(pages, hosts_with(pages, rules)))
    part = lambda path: F.get_json_object("overlay", path)
    return found.select("host", "state", part("$.container_selector").alias("container"), part("$.field_mappings.title").alias("title")).distinct()


@query("""SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, 'section.card' AS container, 'b' AS price FROM pages""")
def peer_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of like price cards propose an overlay for their host."""
    cards = "".join(f'<section class="card x{i}"><b>$100{i}</b></section>' for i in range(3))
    pages = payloads(spark, sf_dir).withColumn("html", F.concat(F.lit("<html><body>"), F.lit(cards), F.lit("</body></html>")))
    found = ex.proposed_overlays(ex.processed(pages))
    part = lambda path: F.get_json_object("overlay", path)
    return found.select("host", part("$.container_selector").alias("container"), part("$.field_mappings.price").alias("price"))


@query(f"""WITH {ARTICLES_SQL} SELECT page_id, 'semantic' AS stage FROM long WHERE title <> ''
UNION ALL SELECT page_id, 'structured' FROM pages WHERE page_id NOT IN (SELECT page_id FROM long WHERE title <> '')""")
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that the schema refuses leaves the page to the next stage."""
    markup = '<div itemscope itemtype="https://schema.org/Thing"><span itemprop="title">t</span></div>'
    pages = payloads(spark, sf_dir).withColumn("html", F.concat("html", F.lit(markup)))
    rows = ex.record_rows(ex.processed(pages, schema=[{"name": "title", "kind": "string", "required": True}, {"name": "missing", "kind": "number"}]))
    return rows.where(F.get_json_object("data", "$.title") != "").select("page_id", "stage")


@query(f"""WITH {ARTICLES_SQL}, s AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0),
c AS (SELECT CASE WHEN s.url IS NULL THEN 'NEW' ELSE 'UPDATED' END AS change_type FROM long LEFT JOIN s ON s.url = long.url) SELECT change_type, count(*) AS n FROM c GROUP BY 1""")
def processed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages against a store that has the URLs of two thirds of the pages with another content, each once."""
    pages = payloads(spark, sf_dir)
    stored = pages.where("page_id % 3 <> 0").select("url").distinct().select("url", F.lit("x").alias("identity_hash"), F.lit("x").alias("content_hash"), F.current_timestamp().alias("first_seen"))
    return stages.audited(pages, stored).groupBy("change_type").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS root, CAST(event_id % 4 AS VARCHAR) AS url, ts AS seen_at, lag(ts) OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts) AS before FROM events)
SELECT root, url, seen_at FROM s WHERE before IS NULL OR epoch_ms(seen_at) - epoch_ms(before) >= 86400000""")
def stream_seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that their crawl tree has not had for a day, as a stream whose state goes by timers."""
    stream = streams.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("root"), (F.col("event_id") % 4).cast("string").alias("url"), F.col("ts").alias("seen_at"))
    with keyed.rocks(spark):
        out = streams.drained(keyed.seen_of_late(stream, "root", "url", "seen_at", 86_400, "400 days"))
    return out.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT user_id, event_type IN ('click', 'purchase') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type <> 'signup'),
f AS (SELECT user_id, coalesce(min(i) FILTER (WHERE ok), 1000000) AS k, count(*) AS n FROM r GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS event_id, CASE WHEN k <= 3 THEN 'delivered' ELSE 'failed' END AS action, least(k, 3) AS attempt FROM f
WHERE (k <= 3 OR n >= 3) AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""")
def stream_outbox_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of outbox events by a table of attempts: delivered at the first success, failed after three failures."""
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type").isin("click", "purchase"), "ok").otherwise("failed")
    messages = streams.table_stream(spark, f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("event_id"), F.lit("jobs_stream").alias("stream"), kind.alias("kind"), F.lit(None).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("at")
    )
    with keyed.rocks(spark):
        out = streams.drained(keyed.deliveries(messages, event_time=True, late="400 days"))
    return out.where("action != 'send'").select("event_id", "action", "attempt")


@query("""SELECT CASE WHEN event_id % 17 = 0 THEN 'unreadable' WHEN event_type <> 'error' THEN 'done' WHEN event_id % 4 >= 2 THEN 'exhausted' ELSE 'retry' END AS fate, count(*) AS n FROM events GROUP BY 1""")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages consumed as a stream: done, to be tried again, and dead, as written."""
    folder, key = streams.work_folder(spark), F.col("event_id")
    body = F.to_json(F.struct(key.cast("string").alias("message_id"), F.lit("task").alias("message_type"), (key % 4).cast("int").alias("retry_count"), F.col("event_type").alias("payload")))
    raw = streams.table_stream(spark, f"{sf_dir}/events.parquet").select(F.when(key % 17 == 0, "{broken").otherwise(body).alias("raw"))
    stages.consume(raw, F.col("m.payload") == "error", f"{folder}/done", f"{folder}/retry", f"{folder}/dead")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    fates = read("done").select(F.lit("done").alias("fate")).unionAll(read("retry").select(F.lit("retry"))).unionAll(read("dead").select("reason"))
    return fates.groupBy("fate").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS record_id, s_name AS title, NULL::VARCHAR AS note FROM supplier")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as one JSON array and read back whole."""
    folder = streams.work_folder(spark)
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("note"))
    sinks.write_json_array(rows, f"{folder}/array")
    lines = spark.read.text(f"{folder}/array", wholetext=True)
    # each part is a piece of the array; commas at its end belong to the next
    part = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace("value", r"^\[\n", ""), r"(,|\n\])\n$", ""), F.lit("]"))
    return lines.select(F.explode(F.from_json(part, "array<struct<record_id:long,title:string,note:string>>")).alias("r")).select("r.*")


@query("""SELECT 'r' || s_suppkey AS record_id, 'generic' AS record_type, NULL::VARCHAR AS schema_version, NULL::VARCHAR AS canonical_url, 'http://x/' || s_suppkey AS source_url,
  NULL::VARCHAR AS first_seen, NULL::VARCHAR AS last_seen, 'NEW' AS change_type FROM supplier""")
def artifact_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), key).alias("record_id"), F.lit("generic").alias("record_type"), F.concat(F.lit("http://x/"), key).alias("source_url"), F.lit("NEW").alias("change_type"), F.lit("{}").alias("data")
    )
    return sinks.artifact_rows(rows)


@query("""SELECT s_suppkey AS page_id, 'p' || s_suppkey AS place_id, s_name AS name, 4.5::DOUBLE AS rating, CASE WHEN s_suppkey % 3 = 0 THEN 'Moderate' END AS price_level FROM supplier WHERE s_suppkey % 4 <> 3""")
def map_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at several depths of a payload; one at a sixth level is not found."""
    key = F.col("s_suppkey")
    place = F.to_json(F.struct(F.concat(F.lit("p"), key).alias("place_id"), F.col("s_name").alias("name"), F.lit(4.5).alias("rating"), F.when(key % 3 == 0, 2).alias("price_level")))
    wrapped = F.when(key % 4 == 0, place).when(key % 4 == 1, F.concat(F.lit('{"x": [1, {"y": {"z": '), place, F.lit("}}]}")))
    wrapped = wrapped.when(key % 4 == 2, F.concat(F.lit('{"result": '), place, F.lit("}"))).otherwise(F.concat(F.lit('[[[[{"deep": '), place, F.lit("}]]]]")))
    rows = maps.place_records(load(spark, sf_dir, "supplier").select(key.alias("page_id"), F.lit(0).alias("payload_no"), wrapped.alias("body")))
    return rows.select("page_id", "place_id", "name", "rating", "price_level")


@query("""SELECT s_suppkey AS page_id, 0 AS pos, s_name AS name, 'id' || s_suppkey AS place_id, 'street, city' AS address, 5.0::DOUBLE AS rating, 12 AS reviews_count, 'http://w' AS website, 40.5::DOUBLE AS latitude, 'cafe' AS category FROM supplier""")
def map_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses by position in a search payload; the payload with the most counts."""
    key = F.col("s_suppkey")
    business = F.concat(
        F.lit('["id'), key, F.lit('", 0, ["street", " ", "city"], 0, [0, 0, 0, 0, 0, 0, 0, 7.5, 12], 0, 0, ["http://w"], 0, [0, 0, 40.5, 22.5], "d", "'), F.col("s_name"), F.lit('", 0, ["cafe"]]')
    )
    full = F.concat(F.lit("[[0, [0, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, "), business, F.lit("]]]]"))
    payload = load(spark, sf_dir, "supplier").select(key.alias("page_id"), F.posexplode(F.array(F.lit("[[0, [0]]]"), full)).alias("payload_no", "body"))
    return maps.search_records(payload).select("page_id", "pos", "name", "place_id", "address", "rating", "reviews_count", "website", "latitude", "category")
