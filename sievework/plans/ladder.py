"""Queries of the whole page ladder, of overlays on sample pages, and of what sites say of themselves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ladder, policies
from ..sources import readers
from ..sources.tables import load
from .pages import ARTICLES_SQL, decoded
from .registry import query

PLACE_ITEM = '<script type="application/ld+json">{"@type": "Restaurant", "name": "Taverna", "url": "http://t/", "telephone": "210", "address": {"streetAddress": "Odos 1", "postalCode": "", "addressCountry": "GR"}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": 7}, "priceRange": "$$"}</script>'
TITLE_SQL = f"""regexp_replace({decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '^\\s+', '')"""


@query(f"""WITH {ARTICLES_SQL}, t AS (SELECT page_id, {TITLE_SQL} || CASE page_id % 6 WHEN 1 THEN ' · Maps - x' ELSE ' - Maps' END AS t FROM pages WHERE page_id % 6 IN (1, 2)),
n AS (SELECT page_id, trim(substr(trim(CASE WHEN contains(t, '·') THEN split_part(t, '·', 1) ELSE regexp_replace(t, '-[^-]*$', '') END), 1, 200)) AS name FROM t)
SELECT page_id, 'map_place' AS stage, name, NULL::VARCHAR AS phone, NULL::DOUBLE AS rating, NULL::VARCHAR AS address FROM n WHERE name <> ''
UNION ALL SELECT page_id, 'map_place', 'Place ' || page_id, NULL, 4.0, NULL FROM pages WHERE page_id % 6 = 0
UNION ALL SELECT page_id, 'map_place', 'Taverna', '210', 4.5, 'Odos 1, GR' FROM pages WHERE page_id % 6 = 3
UNION ALL SELECT page_id, 'map_search', 'Shop ' || page_id, NULL, 5.0, 'street, city' FROM pages WHERE page_id % 6 = 4
UNION ALL SELECT page_id, 'semantic', title, NULL, NULL, NULL FROM long WHERE page_id % 6 = 5""")
def map_page_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken for map pages: places of payloads, of titles and of JSON-LD,
    a search, and pages that are no map pages."""
    key = F.col("page_id")
    kind = key % 6
    html = (
        F.when(kind == 1, F.regexp_replace("html", "</title>", " · Maps - x</title>"))
        .when(kind == 2, F.regexp_replace("html", "</title>", " - Maps</title>"))
        .when(kind == 3, F.concat("html", F.lit(PLACE_ITEM)))
        .otherwise(F.col("html"))
    )
    url = F.when(kind <= 3, F.concat(F.lit("https://www.google.com/maps/place/"), key)).when(kind == 4, "https://www.google.com/maps/search/x").otherwise(F.col("url"))
    pages = load(spark, sf_dir, "pages")
    shown = pages.select("page_id", url.alias("url"), html.alias("html"), F.lit(200).alias("status"))
    place = F.format_string('{"result": {"place_id": "p%s", "name": "Place %s", "rating": 4.0}}', key, key)
    shop = F.format_string('[[0, [0, [0,0,0,0,0,0,0,0,0,0,0,0,0,0,["id%s",0,["street","city"],0,[0,0,0,0,0,0,0,9.0,12],0,0,["http://w"],0,[0,0,40.5,23.5],"d","Shop %s"]]]]]', key, key)
    payloads = pages.where(kind.isin(0, 4, 5)).select("page_id", F.lit(0).alias("payload_no"), F.when(kind == 4, shop).otherwise(place).alias("body"))
    rows = ladder.ladder_records(shown, payloads)
    of = lambda name: F.get_json_object("data", f"$.{name}")
    return rows.select("page_id", "stage", F.coalesce(of("name"), of("title")).alias("name"), of("phone").alias("phone"), of("rating").cast("double").alias("rating"), of("address").alias("address"))


#: Overlays as a model may return them, with faults of every kind; one for each seventh of the pages.
RETURNED = (
    {"container_selector": "article", "field_mappings": {"title": "h1", "text": "p"}},
    {"container_selector": "article", "field_mappings": {"title": "h1.gone", "text": "li"}},
    {"container_selector": "article", "field_mappings": {"title": "h1", "price": ""}},
    {"container_selector": "div::before", "field_mappings": {"title": "h1", "text": "p"}},
    {"container_selector": "section.gone", "field_mappings": {"title": "h1", "text": "p"}},
    {"field_mappings": {"title": "h1"}},
    {"container_selector": "article", "field_mappings": ["title"]},
)


@query("""SELECT page_id, field, fault FROM pages JOIN (VALUES (1, 'title', 'unresolved'), (1, 'text', 'outside'), (2, 'text', 'missing'), (2, 'price', 'extra'), (2, 'price', 'no_selector'),
(3, NULL, 'container_unparsed'), (4, NULL, 'container_unresolved'), (5, NULL, 'no_container'), (6, NULL, 'no_fields')) AS f(kind, field, fault) ON page_id % 7 = kind""")
def overlay_sample_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with returned overlays, seen on the pages they were made from."""
    overlay = F.get(F.array(*(F.lit(json.dumps(x)) for x in RETURNED)), (F.col("page_id") % len(RETURNED)).cast("int"))
    return ladder.sample_faults(load(spark, sf_dir, "pages").select("page_id", overlay.alias("overlay"), "html"), ["title", "text"])


@query("""WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain, count(*) AS n, sum(len(regexp_extract_all(html, '<nav>')))::BIGINT AS navs,
 sum(len(regexp_extract_all(html, '<article>')))::BIGINT AS articles FROM pages GROUP BY 1),
r AS (SELECT domain, n, navs / n::DOUBLE AS c, CASE WHEN len(domain) % 2 = 0 THEN articles / n::DOUBLE ELSE 0 END AS a FROM h WHERE len(domain) % 3 <> 0)
SELECT domain, round(c, 6) AS precision, round(CASE WHEN c - a > 0.1 THEN 1 WHEN c - a < -0.1 THEN -1 ELSE 0 END, 0)::INT AS better,
 CASE WHEN c - a > 0.1 THEN 'promote' WHEN c - a < -0.1 THEN 'demote' ELSE 'no_change' END AS recommendation FROM r WHERE c > 0""")
def overlay_shadow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate overlay against the active one of each host, run on the host's pages."""
    pages = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain"), "html")
    hosts, size = pages.select("domain").distinct(), F.length("domain")
    rules = lambda box, field: F.lit(json.dumps({"container_selector": box, "field_mappings": {"x": field}}))
    states = F.array(
        F.struct(F.when(size % 3 == 0, "RETIRED").otherwise("CANDIDATE").alias("state"), rules("nav", "ul").alias("overlay")),
        F.struct(F.when(size % 2 == 0, "ACTIVE").otherwise("RETIRED").alias("state"), rules("article", "h1").alias("overlay")),
    )
    overlays = hosts.select("domain", F.explode(states).alias("o")).select("domain", "o.*")
    samples = pages.groupBy("domain").agg(F.count("*").alias("n"))
    made = policies.shadow_verdicts(ladder.shadow_outputs(pages, overlays), samples)
    better = F.when(F.col("recommendation") == "promote", 1).when(F.col("recommendation") == "demote", -1).otherwise(0)
    return made.select("domain", F.round("precision", 6).alias("precision"), better.alias("better"), "recommendation")


HOST_SQL = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
#: Pages that a stored sitemap is made of at most.
FILE_PAGES = 300


@query(f"""WITH p AS (SELECT {HOST_SQL} || '/' || (page_id // {FILE_PAGES}) AS host, page_id, url FROM pages),
r AS (SELECT host AS root, url, row_number() OVER (PARTITION BY host ORDER BY page_id % 3 <> 0, page_id % 3, page_id)::INT AS rank FROM p WHERE page_id % 3 <> 2)
SELECT root, rank, url FROM r WHERE rank <= 500""")
def nested_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of sites with a sitemap of their own and an index of two more, of which one could not be fetched."""
    host = F.concat_ws("/", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.floor(F.col("page_id") / FILE_PAGES))
    pages = load(spark, sf_dir, "pages").select(host.alias("host"), "page_id", "url", (F.col("page_id") % 3).alias("part"))
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    # the stored files: of FILE_PAGES pages at most
    own = pages.groupBy("host", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("x")))), lambda r: r["x"]), "").alias("inner"))
    files = own.select(
        F.concat("host", F.lit("/"), "part").alias("url"), F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "inner", F.lit("</urlset>")).alias("xml"),
        F.when(F.col("part") == 2, 404).otherwise(200).alias("status"),
    )
    sites = pages.select("host").distinct()
    entry = lambda n: F.concat(F.lit("<sitemap><loc>"), "host", F.lit(f"/{n}</loc></sitemap>"))
    index = sites.select(F.concat("host", F.lit("/index")).alias("url"), F.concat(F.lit("<sitemapindex>"), entry(1), entry(2), F.lit("</sitemapindex>")).alias("xml"), F.lit(200).alias("status"))
    places = sites.select(F.col("host").alias("root"), F.posexplode(F.array(F.concat("host", F.lit("/0")), F.concat("host", F.lit("/index")))).alias("place_no", "url"))
    return readers.site_pages(places, files.unionByName(index))


@query(f"""WITH p AS (SELECT {HOST_SQL} AS host, page_id FROM pages)
SELECT host, page_id, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) * CASE len(host) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS start_s FROM p""")
def crawl_start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page may be fetched, by the delay its host's robots file asks for."""
    pages = load(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), "page_id")
    asked = F.when(F.length("host") % 3 == 0, "User-agent: *\nCrawl-delay: 3\nCrawl-delay: 5 # s\n").when(F.length("host") % 3 == 1, "User-Agent: x\ncrawl-delay: 9\nUser-agent: *\ncrawl-delay: 2\ncrawl-delay: soon")
    files = pages.select("host").distinct().withColumn("content", asked)
    return readers.crawl_schedule(pages, readers.crawl_delays(files), "page_id", 1.0, run=64)
