import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.functions import relevance, text, web
from sievework.operators import evaluation, jobs, maps, places, records
from sievework.sources import readers, sinks
from sievework.streaming import streams


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "types", "tier"),
    [
        ("ΜΙΚΡΟΒΙΟΛΟΓΙΚΗ ΔΙΑΓΝΩΣΗ", [], "confirmed"), ("Κτηνιατρική Κλινική", ["doctor"], "excluded"), ("Dr. Papas", [], "confirmed"),
        ("Drago Bar", ["bar"], "excluded"), ("Somewhere", ["medical_clinic"], "review"), ("Somewhere", ["store", "doctor"], "confirmed"),
        ("Ωρλ Ιατρείο", None, "confirmed"), ("Nothing", None, "excluded"), (None, ["health", "pharmacy"], "excluded"),
    ],
)
def test_relevance(spark, name, types, tier):
    assert one(spark, relevance.graded_name(F.col("n"), F.col("t"))["tier"], "n string, t array<string>", (name, types)) == tier


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        (None, "none"), ("", "none"), ("n/a", "none"), ("www.vrisko.gr/x", "directory"), ("https://m.facebook.com/p", "social"), ("notfacebook.com", "own"),
        ("doctoranytime.gr/x", "booking"), ("https://OWN.gr:8080/a?b#c", "own"), ("2310 123456", "none"), ("http://user:pw@x.com/", "social"),
    ],
)
def test_website_kind(spark, url, kind):
    assert one(spark, web.website_kind(F.col("u")), "u string", (url,)) == kind


def test_urls(spark):
    canonical = lambda u: one(spark, web.canonical(F.col("u")), "u string", (u,))
    assert canonical("HTTPS://Ex.org/a/b/?q=1#f") == "http://ex.org/a/b?q=1" and canonical("http://ex.org") == "http://ex.org/"
    allowed = lambda u: one(spark, web.allowed(F.col("u"), ("*.ok.org", "ev*l.com"), ("bad.ok.org",)), "u string", (u,))
    assert [allowed(u) for u in ("https://ok.org/", "https://a.ok.org", "https://me@bad.ok.org:81/x", "https://evil.com", "https://no.org")] == [
        "allowed", "allowed", "deny", "allowed", "not_listed"]
    assert one(spark, web.root_job(F.col("j")), "j string", ("rec_rec_j1",)) == "j1"


def test_text(spark):
    fold = one(spark, text.folded(F.col("t")), "t string", ("Άγιος ΪΏ été",))
    assert fold == "αγιος ιω ete"
    personal = spark.sql("select map('Phone', '1', 'note', 'n', 'API-key', null) as m").select(text.without_personal(F.col("m"))).first()[0]
    assert personal == {"Phone": "[REDACTED]", "note": "n", "API-key": None}
    assert one(spark, text.without_hidden(F.col("t")), "t string", ("a​b\x07c",)) == "abc"
    assert one(spark, text.citation_coverage(F.col("t")), "t string", ("  ",)) == 1.0


def test_throttle_steps(spark):
    step = lambda current, latency, ok, retry: one(
        spark, evaluation.next_delay(*map(F.col, ("c", "l", "o", "r")), 0.0, 2, 60_000.0), "c double, l double, o boolean, r double", (current, latency, ok, retry)
    )
    assert step(0.0, 100.0, True, None) == 50.0 and step(100.0, 100.0, True, None) == 100.0
    assert step(200.0, 100.0, False, 30.0) == 30_000.0 and step(200.0, 100.0, False, None) == 400.0 and step(50_000.0, 1.0, False, None) == 60_000.0


def test_transitions(spark):
    ok = lambda a, b: one(spark, jobs.may_become(F.col("a"), F.col("b")), "a string, b string", (a, b))
    assert ok("QUEUED", "RUNNING") and ok("FAILED", "QUEUED") and not ok("DELETED", "QUEUED") and not ok("SUCCEEDED", "FAILED")


def test_keyset_pages_and_bad_cursor(spark):
    rows = spark.createDataFrame([(1, f"r{i}", datetime(2024, 1, 1)) for i in range(5)], "job_id long, record_id string, created_at timestamp_ntz")
    first = jobs.after_cursor(rows, 1, None, 2).collect()
    assert [r.record_id for r in first] == ["r0", "r1", "r2"]
    assert [r.record_id for r in jobs.after_cursor(rows, 1, "2024-01-01T00:00:00|r1", 2).collect()] == ["r2", "r3", "r4"]
    with pytest.raises(Exception, match="bad cursor"):
        jobs.after_cursor(rows, 1, "nonsense", 2).collect()


def test_phone_and_ratio(spark):
    digits = {one(spark, places.phone_digits(F.col("p")), "p string", (p,)) for p in ("2392021745", "2392 021745", "+30 2392 021745", "0030 2392021745")}
    assert digits == {"2392021745"}
    assert records.title_ratio("abcd", "abcd") == 100 and records.title_ratio("", "") == 100 and records.title_ratio("ab", "ba") == 50
    assert records.common_length("kitten", "sitting") == 4


def test_change_cases(spark):
    schema = "k string, identity_hash string, content_hash string, first_seen int"
    stored = spark.createDataFrame([("a", "h", "c", 1), ("b", "h", "c", 1), ("d", None, "c", 1), ("e", None, None, 1)], schema)
    new = spark.createDataFrame([("a", "h", "x", 2), ("b", "i", "c", 2), ("d", "h", "c", 2), ("e", "h", None, 2), ("f", "h", "c", 2)], schema)
    got = {r.k: (r.change_type, r.first_seen) for r in records.changes(new, stored, "k").collect()}
    assert got == {"a": ("UNCHANGED", 1), "b": ("UPDATED", 1), "d": ("UNCHANGED", 1), "e": ("UNCHANGED", 1), "f": ("NEW", 2)}


def test_map_payloads(spark):
    entry = [None] * 179
    entry[0], entry[2], entry[7], entry[9], entry[10], entry[11] = "ChIJ12345", ["123 Main St", "Springfield", "IL"], ["https://example.com"], [None, None, 40.7128, -74.006], "data_abc", " Test Business "
    entry[4] = [None] * 7 + [7.5, 231]
    entry[13], entry[30], entry[34], entry[178] = ["Pizza", "Italian"], "America/New_York", [None] * 4 + [[None] * 4 + ["Permanently closed"]], [["+1 555-1234"]]
    body = json.dumps([[None, [None, [None] * 14 + [entry], [None] * 14 + [[None] * 12]]]])
    rows = spark.createDataFrame([(1, 0, "[]"), (1, 1, body), (2, 0, "{bad")], "page_id long, payload_no int, body string")
    (r,) = maps.search_records(rows).collect()
    assert (r.name, r.place_id, r.address, r.rating, r.reviews_count) == ("Test Business", "ChIJ12345", "123 Main St, Springfield, IL", 5.0, 231)
    assert (r.website, r.latitude, r.longitude, r.category, r.status, r.phone) == ("https://example.com", 40.7128, -74.006, "Pizza", "Permanently closed", "+15551234")
    place = {"result": {"place_id": "p", "name": "N", "geometry": {"location": {"lat": 1.5}}, "types": ["cafe"], "price_level": 2, "international_phone_number": "+1", "reviews": [{"author_name": "A", "text": "t" * 3000}]}}
    (p,) = maps.place_records(spark.createDataFrame([(1, 0, json.dumps(place)), (2, 0, "{}")], "page_id long, payload_no int, body string")).collect()
    assert (p.name, p.latitude, p.category, p.price_level, p.phone, len(p.reviews[0].text)) == ("N", 1.5, "cafe", "Moderate", "+1", 2000)


def test_readers(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# c\nAigli hotel | hotel\nΚΟΥΡΕΙΟ # note\n | x\n", encoding="utf-8")
    assert [(r.prefix, r.reason) for r in readers.exclusion_rules(spark, str(tmp_path / "rules.txt")).orderBy("rule_no").collect()] == [("Aigli hotel", "hotel"), ("ΚΟΥΡΕΙΟ", "")]
    (tmp_path / "p.html").write_text("<p>a\nb</p>")
    assert readers.html_files(spark, str(tmp_path / "p.html"), "http://x").first() == ("http://x", "<p>a\nb</p>")
    maps_ = [("r", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a/1 </loc></url></urlset>'), ("r", "<sitemapindex><sitemap><loc>http://a/s</loc></sitemap></sitemapindex>"), ("q", "<!DOCTYPE x><urlset/>"), ("q", "bad")]
    assert sorted(readers.sitemap_urls(spark.createDataFrame(maps_, "root string, xml string")).collect()) == [("r", "http://a/1", False), ("r", "http://a/s", True)]
    robots = spark.createDataFrame([("h", "User-agent: x\nDisallow: /x\nUser-agent: *\n# c\nDisallow: /a\nDisallow:\nSitemap: http://h/s.xml"), ("g", "")], "host string, content string")
    rules = readers.robots_rules(robots)
    assert rules.collect() == [("h", "/a")]
    assert sorted(readers.robots_sitemaps(robots).collect()) == [("g", "https://g/sitemap.xml"), ("h", "http://h/s.xml")]
    urls = spark.createDataFrame([("h", "/a/b", 200), ("h", "/c", 200), ("g", "/", 404), ("k", "/", 500)], "host string, path string, status int")
    assert sorted((r.host, r.path, r.allowed) for r in readers.robots_allowed(urls, rules).collect()) == [("g", "/", True), ("h", "/a/b", False), ("h", "/c", True), ("k", "/", False)]
    body = json.dumps({"organic": [{"link": "u1", "title": "t"}, {"link": "u2"}, {"link": "u3"}]})
    assert [r.url for r in readers.search_hits(spark.createDataFrame([(1, body), (2, "{")], "query_id int, body string"), 2).collect()] == ["u1", "u2"]
    body = json.dumps({"annotations": [{"url_citation": {"url": u, "title": u}} for u in ("a", "b", "a", "c")]})
    assert [(r.rank, r.url) for r in readers.cited_hits(spark.createDataFrame([(1, body)], "query_id int, body string"), 2).orderBy("rank").collect()] == [(0, "a"), (1, "b")]
    body = json.dumps({"places": [{"id": "p", "displayName": {"text": " N "}, "internationalPhoneNumber": "+30", "location": {"latitude": 1.0}}, {"id": ""}, {"id": "p", "displayName": {"text": "M"}}]})
    rows, flags = readers.places(spark.createDataFrame([(1, body)], "call_id int, body string"), 3)
    assert [(r.place_id, r.name, r.phone, r.latitude) for r in rows.collect()] == [("p", "N", "+30", 1.0)] and flags.first().truncated
    got = readers.captured_json(spark.createDataFrame([(1, 0, "application/json", ")]}'\n[1]"), (1, 1, "text/html", "[2]"), (1, 2, "application/json", "bad"), (1, 3, "x/json", "[3, 4]")], "page_id int, pos int, media_type string, body string"), 100, 2, 1000)
    assert [r.body for r in got.orderBy("pos").collect()] == ["[1]", "[3, 4]"]
    assert readers.seed_tasks(spark, [{"name": "a", "start_urls": ["u", "v"]}, {"name": "b", "enabled": False, "start_urls": ["w"]}]).count() == 2


def test_sinks(spark, tmp_path):
    rows = [("r1", "article", "http://x", "NEW", '{"b": 1, "a key": {"c": ["<", "\\u0001"]}}', 0), ("r2", "list", "http://y", "UPDATED", '{"d": "é", "b": null}', 1)]
    table = spark.createDataFrame(rows, "record_id string, record_type string, source_url string, change_type string, data string, seq int")
    wide = sinks.with_data_columns(table)
    assert wide.columns == ["seq", "record_id", "record_type", "source_url", "change_type", "b", "a key", "d"]
    assert [(r.b, r["a key"], r.d) for r in wide.orderBy("seq").collect()] == [("1", '{"c":["<","\\u0001"]}', ""), ("", "", "é")]
    xml = table.orderBy("seq").select(sinks.xml_records(table.select("record_id", "data")).alias("x")).first().x
    assert xml == '<record><record_id>r1</record_id><data><b>1</b><a_key name="a key"><c><item>&lt;</item><item></item></c></a_key></data></record>'
    sinks.write_report(table, str(tmp_path / "report"))
    count = lambda name: spark.read.option("header", True).csv(str(tmp_path / "report" / name)).count()
    assert [count(n) for n in ("all", "new", "updated")] == [2, 1, 1]
    sinks.write_jsonl(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    blobs = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    for _ in range(2):
        sinks.store_artifacts(blobs, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert sinks.chat_messages(table, 1).first().message == "- article http://x"


def test_streams(spark, tmp_path):
    for i, ids in enumerate(([1, 2, 3], [4, 5, 6])):
        spark.createDataFrame([("r", x) for x in ids], "root string, item long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}.parquet"))
    stream = spark.readStream.schema("root string, item long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = streams.drained(streams.granted(stream, "root", "item", 4)).collect()
    assert len(got) == 4
    seen = []
    streams.each_batch(stream, lambda batch, _: seen.append(batch.count()))
    assert sum(seen) == 6
    events = spark.createDataFrame([("job.failed",), ("discovery.new",), ("other",)], "event_type string")
    assert [r.stream for r in streams.routed(events).collect()] == ["jobs_stream", "discovery_stream", "events_stream"]


def test_throttle_equals_the_fold_step_by_step(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in "abc":
        delay, n = 0.0, rng.randint(5, 60)
        for i in range(n):
            latency, ok, retry = rng.uniform(10, 900), rng.random() < 0.8, rng.choice([None, None, 2.0])
            rows.append((k, datetime(2024, 1, 1) + timedelta(minutes=17 * i), i, latency, ok, retry))
            penalty = 0.0 if ok else retry * 1000 if retry is not None else 2 * delay
            delay = min(60_000.0, max((delay + latency / 2) / 2, latency / 2, penalty, delay, 100.0))
        want[k] = (n, delay)
    steps = spark.createDataFrame(rows, "k string, created_at timestamp, observation_id long, latency_ms double, success boolean, retry_after_s double")
    got = {r.k: (r.n, r.delay_ms) for r in evaluation.throttled(steps, "k").collect()}
    assert all(got[k][0] == n and abs(got[k][1] - d) < 1e-6 for k, (n, d) in want.items())


def test_long_words_are_redacted_in_linear_time(spark):
    began = time.time()
    long = "x" * 400_000 + " " + "a.b-" * 100_000 + " 1http://me:pw@h.org " + "y@" * 1000
    got = one(spark, text.redacted_log(F.col("t")), "t string", (long,))
    assert "1http://[dsn redacted]" in got and "pw@" not in got and time.time() - began < 60
