import json

from pyspark.sql import functions as F

from sievework.operators import ladder
from sievework.sources import readers

PAGES = "page_id long, url string, html string, status int"
PLACE, SEARCH = "https://www.google.com/maps/place/x", "https://www.google.com/maps/search/x"
SHOP = json.dumps([[0, [0, [0] * 14 + [["id", 0, ["s"]] + [0] * 8 + ["Shop"]]]]])
ITEM = '<script type="application/ld+json">{}</script>'


def names(spark, pages, payloads=(), overlays=None, schema=None):
    rows = ladder.ladder_records(spark.createDataFrame(pages, PAGES), spark.createDataFrame(list(payloads), "page_id long, payload_no int, body string"), overlays, schema)
    return sorted((r.page_id, r.stage, json.loads(r.data).get("name")) for r in rows.collect())


def test_map_pages_in_the_ladder(spark):
    item = json.dumps({"@type": "LocalBusiness", "name": "Item", "openingHoursSpecification": {"a": "b"}})
    pages = [
        (1, PLACE, "<title> Name here · a - b</title>", 200), (2, PLACE, "<title>A - B - Maps</title>", 200), (3, PLACE, "<title>Maps</title>", 200),
        (4, PLACE, f"<title>T - x</title>{ITEM.format('[1]')}{ITEM.format('{bad')}{ITEM.format(item)}", 200), (5, PLACE, f"<title>T - x</title>{ITEM.format(json.dumps({'@type': 'Place'}))}", 200),
        (6, PLACE, "<title>T - x</title>", 404), (7, PLACE, "<title>T - x</title>", 200), (8, SEARCH, "", 200), (9, "http://x/", "<title>T - x</title>", 200), (10, None, None, None), (11, PLACE, None, 200),
    ]
    payloads = [(7, 1, '{"place_id": "b", "name": "Second"}'), (7, 0, '{"x": {"place_id": "a", "name": "First"}}'), (8, 0, SHOP), (9, 0, SHOP), (7, 2, None), (6, 0, '{"place_id": "b", "name": "No"}')]
    got = names(spark, pages, payloads)
    assert [x for x in got if x[0] != 5] == [(1, "map_place", "Name here"), (2, "map_place", "A - B"), (4, "map_place", "Item"), (7, "map_place", "First"), (8, "map_search", "Shop")]
    assert [x[1] for x in got if x[0] == 5] == ["json_ld"]  # an item without a name names no place
    assert names(spark, pages[:0]) == []


def test_mappings_come_before_map_stages_and_the_schema_after(spark):
    pages = [(1, PLACE, "<title>T - x</title><h1>H</h1>", 200)]
    overlays = spark.createDataFrame([("www.google.com", json.dumps({"mappings": {"name": "h1"}}))], "host string, overlay string")
    assert names(spark, pages, overlays=overlays) == [(1, "mappings", "H")]
    assert names(spark, pages, schema=[{"name": "name", "required": True}]) == [(1, "map_place", "T")]
    assert names(spark, pages, schema=[{"name": "rating", "required": True}]) == []


def test_faults_of_overlays_on_samples(spark):
    html = "<div class=a><b>1</b></div><b>2</b><i>3</i>"
    rules = [{"container_selector": ".a", "field_mappings": {"t": ".a b"}}, {"container_selector": ".a", "field_mappings": {"t": "b", "u": "s", "v": "b::x", "w": 5}}, None, 7]
    table = spark.createDataFrame([(i, json.dumps(r) if r else None, html) for i, r in enumerate(rules)] + [(4, "{bad", None)], "n int, overlay string, html string")
    got = sorted((r.n, r.field or "", r.fault) for r in ladder.sample_faults(table, ["t"]).collect())
    want = [(1, f, "extra") for f in "uvw"] + [(1, "t", "outside"), (1, "u", "unresolved"), (1, "v", "unparsed"), (1, "w", "no_selector")] + [(n, "", "no_container") for n in (2, 3, 4)]
    assert got == sorted(want)


def test_shadow_runs_need_a_candidate(spark):
    rule = json.dumps({"container_selector": "li", "field_mappings": {"x": "b"}})
    other = json.dumps({"container_selector": "p", "field_mappings": {"x": "b"}})
    pages = spark.createDataFrame([("a", "<li><b>1</b><li><b>2</b><p><b>3</b></p>"), ("a", None), ("b", "<li><b>1</b>"), ("c", "<li><b>1</b>")], "domain string, html string")
    overlays = spark.createDataFrame([("a", "SHADOW", rule), ("a", "ACTIVE", other), ("b", "ACTIVE", rule), ("c", "CANDIDATE", rule), ("c", "RETIRED", other)], "domain string, state string, overlay string")
    got = {(r.domain, r.role): r["count"] for r in ladder.shadow_outputs(pages, overlays).groupBy("domain", "role").count().collect()}
    assert got == {("a", "candidate"): 2, ("a", "active"): 1, ("c", "candidate"): 1}


def test_nested_sitemaps_in_order_up_to_a_bound(spark):
    pages = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    index = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    files = [("i", index("s2", "gone", "s1", "i2"), 200), ("s1", pages("a", "b"), 200), ("s2", pages("c"), 200), ("i2", index("s1"), 200), ("own", pages("d", "a"), 200), ("bad", "<", 200), ("no", pages("x"), 500)]
    places = [("r", 0, "i"), ("r", 1, "own"), ("q", 0, "bad"), ("q", 1, "no"), ("q", 2, "s1")]
    rows = readers.site_pages(spark.createDataFrame(places, "root string, place_no int, url string"), spark.createDataFrame(files, "url string, xml string, status int"), 4)
    assert sorted((r.root, r["rank"], r.url) for r in rows.collect()) == [("q", 1, "a"), ("q", 2, "b"), ("r", 1, "c"), ("r", 2, "a"), ("r", 3, "b"), ("r", 4, "d")]


def test_crawl_delays_and_a_host_over_many_runs(spark):
    files = [("h", "User-agent: x\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: 2 # s\nCrawl-delay: soon"), ("g", "User-agent: x\nCrawl-delay: 9"), ("k", None)]
    delays = readers.crawl_delays(spark.createDataFrame(files, "host string, content string"))
    assert [tuple(r) for r in delays.collect()] == [("h", 2.0)]
    urls = spark.range(0, 500).select(F.when(F.col("id") % 50 == 7, "g").otherwise("h").alias("host"), (F.col("id") * 3 - 100).alias("k"))
    got = {(r.host, r.k): r.start_s for r in readers.crawl_schedule(urls, delays, "k", 0.5, run=40).collect()}
    for host, delay in (("h", 2.0), ("g", 0.5)):
        keys = sorted(k for h, k in got if h == host)
        assert keys and [got[host, k] for k in keys] == [i * delay for i in range(len(keys))]
    assert readers.crawl_schedule(urls.limit(0), delays, "k").count() == 0
