"""Queries that read HTML pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..sources.tables import load
from .registry import query

#: Markup that the pages lack, put before the body's end of some of them.
FRAGMENTS = (
    '<script type="application/ld+json">[{"@type": ["Product", "Thing"], "name": "Widget", "offers": {"price": "9.99"}}, {"@graph": [{"@type": "Offer", "price": 5}]}]</script>',
    '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Widget</span><meta itemprop="sku" content="w1"></div>',
    "<table><tr><th>a<th>b<tr><td>1<td>2</table>",
    '<section class="card x"><b>$1,000</b></section><section class="card"><b>$1001</b></section><section class="card y"><b>$1002</b></section>',
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit(200).alias("status"))


def decoded(text: str) -> str:
    """SQL: the text with its character references resolved."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("amp", "&")):
        text = f"replace(replace({text}, '&{name};', '{char}'), '&{name}', '{char}')"
    return text


def joined_text(html: str) -> str:
    """SQL: the trimmed pieces of text between tags, one after the other."""
    pieces = f"list_transform(string_split_regex({html}, '<[^>]*>'), lambda x: regexp_replace({decoded('x')}, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string({pieces}, '')"


ARTICLES_SQL = f"""
art AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages WHERE contains(html, '<article>')),
txt AS (SELECT page_id, url, html, body, {joined_text("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)")} AS title, {joined_text('body')} AS text FROM art),
long AS (SELECT * FROM txt WHERE length(text) > 50)
"""


@query(f"""WITH {ARTICLES_SQL} SELECT page_id, 1::BIGINT AS n_articles, title FROM long""")
def extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an article that is long enough, how many, and the first one's title."""
    rows = ex.record_rows(ex.processed(payloads(spark, sf_dir))).where("record_type = 'article'")
    title = F.min_by(F.get_json_object("data", "$.title"), "ordinal")
    return rows.groupBy("page_id").agg(F.count("*").alias("n_articles"), title.alias("title"))


@query(f"""WITH {ARTICLES_SQL} SELECT page_id, 'article' AS record_type, 'semantic' AS stage, 0 AS ordinal, title, sha256(substr(text, 1, 5000)) AS text_hash FROM long""")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all pages, with type, stage, title and the hash of the text."""
    rows = ex.record_rows(ex.processed(payloads(spark, sf_dir)))
    title, text = (F.get_json_object("data", f"$.{x}") for x in ("title", "text"))
    return rows.select("page_id", "record_type", "stage", "ordinal", title.alias("title"), F.sha2(text, 256).alias("text_hash"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS site, unnest(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: string_split(h, '#')[1])) AS href,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS k FROM pages),
b AS (SELECT page_id, site || href AS url, min(k) AS k FROM a WHERE href <> '' AND starts_with(href, '/') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS place FROM b)
SELECT page_id, url, 1 AS depth FROM r WHERE place <= 50""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that each page leads to, one step deeper."""
    return ex.follow_rows(ex.processed(payloads(spark, sf_dir)), 0, 2).where("depth = 1")


@query(f"""WITH {ARTICLES_SQL} SELECT p.page_id, CASE WHEN l.page_id IS NULL THEN 0 ELSE 1 END AS ordinal, '{{"items": ["one", "two", "three"]}}' AS data
FROM pages p LEFT JOIN long l ON l.page_id = p.page_id WHERE p.page_id % 3 = 0""")
def extract_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists outside navigation: some pages get one put in."""
    made = F.concat("html", F.when(F.col("page_id") % 3 == 0, "<ul><li>one<li>two<li>three</ul>").otherwise(""))
    rows = ex.record_rows(ex.processed(payloads(spark, sf_dir).withColumn("html", made)))
    return rows.where("record_type = 'list'").select("page_id", "ordinal", "data")


@query("""SELECT p.page_id, record_type, stage, ordinal, data FROM pages p JOIN (VALUES
(0, 0, 'product', 'json_ld', '{"@type": ["Product", "Thing"], "name": "Widget", "offers": {"price": "9.99"}}'),
(0, 1, 'offer', 'json_ld', '{"@type": "Offer", "price": 5}'),
(1, 0, 'product', 'structured', '{"name": "Widget", "sku": "w1"}'),
(2, 0, 'table', 'semantic', '{"headers": ["a", "b"], "rows": [["a", "b"], ["1", "2"]]}'),
(3, 0, 'content_addressed', 'content_addressed', '{"price": "$1,000"}'),
(3, 1, 'content_addressed', 'content_addressed', '{"price": "$1001"}'),
(3, 2, 'content_addressed', 'content_addressed', '{"price": "$1002"}')) AS t(kind, ordinal, record_type, stage, data) ON p.page_id % 4 = kind""")
def extract_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD, microdata, tables and price cards in place of the articles."""
    kind = F.get(F.array(*map(F.lit, FRAGMENTS)), (F.col("page_id") % len(FRAGMENTS)).cast("int"))
    body = F.regexp_replace("html", r"(?s)<article>.*</article>", "")
    rows = ex.record_rows(ex.processed(payloads(spark, sf_dir).withColumn("html", F.concat(body, kind))))
    return rows.select("page_id", "record_type", "stage", "ordinal", "data")


def hosts_with(pages: DataFrame, rules: dict) -> DataFrame:
    """(host, overlay): every host with the same overlay."""
    return pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct().withColumn("overlay", F.lit(json.dumps(rules)))


@query(f"""WITH {ARTICLES_SQL} SELECT page_id, 'overlay' AS stage, title FROM txt""")
def extract_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a stored overlay give its fields and nothing else."""
    pages = payloads(spark, sf_dir)
    rows = ex.record_rows(ex.processed(pages, hosts_with(pages, {"container_selector": "article", "field_mappings": {"title": "h1", "first": "p"}})))
    return rows.select("page_id", "stage", F.get_json_object("data", "$.title").alias("title"))


@query(f"""WITH {ARTICLES_SQL} SELECT page_id, title FROM txt""")
def element_signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field whose selector no longer fits is found by its signature."""
    old = {"tag": "h1", "attrs": {}, "text": "", "ancestor_tags": ["article", "body", "html"], "parent_tag": "article", "parent_attrs": {}, "parent_text": "", "sibling_tags": ["h1", "p"]}
    rules = {"container_selector": "article", "field_mappings": {"title": "h1.gone"}, "field_signatures": {"title": old}}
    pages = payloads(spark, sf_dir)
    rows = ex.record_rows(ex.processed(pages, hosts_with(pages, rules)))
    return rows.where("stage = 'overlay'").select("page_id", F.get_json_object("data", "$.title").alias("title"))
