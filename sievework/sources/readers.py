"""Sources: files of pages, lists and settings, and stored API answers, as tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import parse

MAX_SITEMAP_URLS = 500
JSON_PREFIX = r"^\)\]\}'[^\n]*\n?"
PLACE = (
    "id:string,displayName:struct<text:string>,formattedAddress:string,websiteUri:string,nationalPhoneNumber:string,"
    "internationalPhoneNumber:string,primaryTypeDisplayName:struct<text:string>,primaryType:string,types:array<string>,"
    "location:struct<latitude:double,longitude:double>,rating:double,userRatingCount:int,googleMapsUri:string,businessStatus:string"
)


def html_files(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    """(url, html) of whole files; the path stands for the URL where none is given."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select((F.lit(url) if url else F.input_file_name()).alias("url"), F.col("value").alias("html"))


def exclusion_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_no, prefix, reason) of lines `prefix | reason`; # starts a comment."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("rule_no", "line"))
    plain = F.trim(F.split("line", "#")[0])
    reason = F.trim(F.regexp_extract(plain, r"^[^|]*\|(.*)$", 1))
    return lines.select("rule_no", F.trim(F.split(plain, r"\|")[0]).alias("prefix"), reason.alias("reason")).where("prefix <> ''")


def seed_tasks(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(name, url) of the start URLs of enabled sources, as a settings file lists them."""
    rows = [(s.get("name"), s.get("enabled"), list(s.get("start_urls") or [])) for s in sources]
    table = spark.createDataFrame(rows, "name string, enabled boolean, urls array<string>")
    return table.where(F.coalesce("enabled", F.lit(True))).select("name", F.explode("urls").alias("url"))


def extraction_schema(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def sitemap_entries(xml: Column) -> Column:
    """Struct of whether a sitemap is an index, and its places in order; none of
    what does not parse, or declares entities."""

    @F.pandas_udf("struct<nested:boolean,urls:array<string>>")
    def entries(part: pd.Series) -> pd.DataFrame:
        rows = []
        for text in part:
            try:
                if not text or "<!DOCTYPE" in text or "<!ENTITY" in text:
                    raise ET.ParseError("no document type wanted")
                top = ET.fromstring(text)
            except ET.ParseError:
                rows.append((False, []))
                continue
            urls = [x.text.strip() for entry in top for x in entry if x.tag.rsplit("}", 1)[-1] == "loc" and x.text]
            rows.append((top.tag.rsplit("}", 1)[-1] == "sitemapindex", urls))
        return pd.DataFrame(rows, columns=["nested", "urls"])

    return entries.asNondeterministic()(xml)  # one parse a file


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """(root, url, nested) from (root, xml): pages of a urlset, sitemaps of an
    index. At most MAX_SITEMAP_URLS pages a root."""
    found = documents.select("root", sitemap_entries(F.col("xml")).alias("p"))
    rows = found.select("root", "p.nested", F.posexplode("p.urls").alias("pos", "url"))
    rank = F.row_number().over(Window.partitionBy("root", "nested").orderBy("pos", "url"))
    return rows.withColumn("rank", rank).where(F.col("nested") | (F.col("rank") <= MAX_SITEMAP_URLS)).select("root", "url", "nested")


def site_pages(places: DataFrame, files: DataFrame, most: int = MAX_SITEMAP_URLS) -> DataFrame:
    """(root, rank, url): the first `most` pages of each site, by its sitemaps.

    places: (root, place_no, url) of the sitemaps that a site names, in order;
    files: (url, xml, status) of those that were fetched, nested ones too. A
    sitemap's own pages come where it stands, those of an index in the order
    of its entries; an index within an index, and what was not fetched with
    status 200, is passed over. Each file is parsed once, however often it is named.
    """
    read = files.where("status = 200").select(F.col("url").alias("file"), sitemap_entries(F.col("xml")).alias("p")).select("file", "p.*")
    pages = read.where("not nested").select("file", F.posexplode("urls").alias("pos", "page"))
    inner = read.where("nested").select("file", F.posexplode("urls").alias("index_no", "inner"))
    named = places.select("root", "place_no", F.col("url").alias("file"))
    below = named.join(inner, "file").select("root", "place_no", (F.col("index_no") + 1).alias("index_no"), F.col("inner").alias("file"))
    rows = named.withColumn("index_no", F.lit(0)).unionByName(below).join(pages, "file")
    rank = F.row_number().over(Window.partitionBy("root").orderBy("place_no", "index_no", "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("root", "rank", F.col("page").alias("url"))


def crawl_delays(files: DataFrame) -> DataFrame:
    """(host, delay_s) that robots files (host, content) ask of every agent; only whole seconds count, the last one of a file."""
    lines = files.select("host", F.posexplode(F.split("content", "\\r?\\n")).alias("n", "line")).select("host", "n", F.trim(F.substring_index("line", "#", 1)).alias("line"))
    agent = F.trim(F.regexp_extract("line", "(?i)^user-agent:(.*)$", 1))
    order = Window.partitionBy("host").orderBy("n")  # one file
    section = F.last(F.when(F.col("line").rlike("(?i)^user-agent:"), agent), ignorenulls=True).over(order)
    delay = F.regexp_extract("line", r"(?i)^crawl-delay:\s*(\d+)$", 1)
    return lines.withColumn("agent", section).withColumn("delay", delay).where("agent = '*' and delay <> ''").groupBy("host").agg(F.max_by(F.col("delay").cast("double"), "n").alias("delay_s"))


def crawl_schedule(urls: DataFrame, delays: DataFrame, key: str, default_s: float = 0.0, run: int = 10_000) -> DataFrame:
    """urls (host, key long and others) with start_s: a host's URLs start one delay apart, by key.

    Keys are unique. A host's places are counted in runs of keys, then summed
    over the runs, so that no host is ordered in one task.
    """
    part = F.floor(F.col(key) / run)
    counts = urls.groupBy("host", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("host", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("host", "part").orderBy(key)) - 1
    placed = urls.withColumn("part", part).withColumn("place", place).join(offsets, ["host", "part"]).join(delays, "host", "left")
    start = (F.col("place") + F.col("before")) * F.coalesce("delay_s", F.lit(default_s))
    return placed.withColumn("start_s", start).drop("part", "place", "before", "delay_s")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, path) that robots files (host, content) disallow for every agent."""
    lines = files.select("host", F.posexplode(F.split("content", "\n")).alias("n", "line")).select("host", "n", F.trim("line").alias("line"))
    lines = lines.where("line <> '' and not line like '#%'")
    agent = F.trim(F.regexp_extract("line", "(?i)^user-agent:(.*)$", 1))
    order = Window.partitionBy("host").orderBy("n")  # one file
    section = F.last(F.when(F.col("line").rlike("(?i)^user-agent:"), agent), ignorenulls=True).over(order)
    path = F.trim(F.regexp_extract("line", "(?i)^disallow:(.*)$", 1))
    return lines.withColumn("agent", section).withColumn("path", path).where("agent = '*' and path <> ''").select("host", "path")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(host, url) of the sitemaps that robots files name, else the usual place."""
    found = F.regexp_extract_all("content", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    usual = F.array(F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")))
    return files.select("host", F.explode(F.when(F.size(found) > 0, found).otherwise(usual)).alias("url"))


def robots_allowed(urls: DataFrame, rules: DataFrame, missing: str = "allow") -> DataFrame:
    """urls (host, path, status of the robots file) with `allowed`: a missing
    file allows all where missing is "allow"; any other failure denies."""
    hits = urls.join(rules.withColumnRenamed("path", "rule"), "host").where(F.startswith("path", "rule")).select("host", "path").distinct()
    banned = urls.join(hits.withColumn("hit", F.lit(True)), ["host", "path"], "left")
    fetched = F.when(F.col("status") == 200, F.col("hit").isNull()).otherwise((F.col("status") == 404) & F.lit(missing == "allow"))
    return banned.withColumn("allowed", fetched).drop("hit")


def search_hits(answers: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, url, title, snippet) of the first n entries of stored search answers (query_id, body)."""
    body = F.from_json("body", "organic array<struct<link:string,title:string,snippet:string>>")
    rows = answers.select("query_id", F.posexplode(body["organic"]).alias("rank", "o")).where(F.col("rank") < n)
    return rows.select("query_id", "rank", F.col("o.link").alias("url"), "o.title", "o.snippet").where("url is not null")


def cited_hits(answers: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, url, title) of the first n distinct cited URLs, in the order they are first cited."""
    body = F.from_json("body", "annotations array<struct<url_citation:struct<url:string,title:string>>>")
    rows = answers.select("query_id", F.posexplode(body["annotations"]).alias("pos", "a")).where("a.url_citation.url is not null")
    first = rows.groupBy("query_id", F.col("a.url_citation.url").alias("url")).agg(F.min("pos").alias("pos"), F.min_by("a.url_citation.title", "pos").alias("title"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1
    return first.withColumn("rank", rank).where(F.col("rank") < n).select("query_id", "rank", "url", "title")


def filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def places(answers: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Places of stored answers (call_id, body), one row a place of a call; and
    (call_id, truncated), which counts all entries, readable or not."""
    body = F.from_json("body", f"places array<struct<{PLACE}>>")
    read = answers.withColumn("entries", body["places"])
    flags = read.select("call_id", (F.size("entries") >= cap).alias("truncated"))
    p = read.select("call_id", F.posexplode("entries").alias("pos", "p"))
    rows = p.select(
        "call_id", "pos", F.trim("p.id").alias("place_id"), F.trim("p.displayName.text").alias("name"), F.trim(F.coalesce("p.formattedAddress", F.lit(""))).alias("address"),
        filled(F.col("p.websiteUri")).alias("website"), F.coalesce(filled(F.col("p.nationalPhoneNumber")), filled(F.col("p.internationalPhoneNumber"))).alias("phone"),
        F.coalesce(filled(F.col("p.primaryTypeDisplayName.text")), F.col("p.primaryType"), F.lit("")).alias("primary_type"), "p.types",
        "p.location.latitude", "p.location.longitude", "p.rating", F.col("p.userRatingCount").alias("reviews_count"), F.col("p.businessStatus").alias("business_status"),
    ).where("place_id <> '' and name <> ''")
    rank = F.row_number().over(Window.partitionBy("call_id", "place_id").orderBy("pos"))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank"), flags


def captured_json(responses: DataFrame, most_chars: int, most_count: int, most_total: int) -> DataFrame:
    """Stored responses (page_id, pos, media_type, body) that are JSON, without
    their guard prefix; each, their number and their sum are bounded a page."""
    body = F.regexp_replace("body", JSON_PREFIX, "")
    read = responses.where(F.contains("media_type", F.lit("json"))).withColumn("body", body).withColumn("data", F.try_parse_json("body"))
    read = read.where(F.col("data").isNotNull() & (F.length("body") <= most_chars))
    order = Window.partitionBy("page_id").orderBy("pos")
    total = F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return read.withColumn("n", F.row_number().over(order)).withColumn("total", total).where((F.col("n") <= most_count) & (F.col("total") <= most_total)).drop("n", "total")


HIT = "array<struct<rank:int,url:string,title:string,snippet:string>>"


def result_hits(pages: DataFrame, html: str = "html", most: int = 10) -> DataFrame:
    """Hits in search-result pages: one row a linked result, at most `most` a
    page, its rank counted among all results from 0."""

    @F.pandas_udf(HIT)
    def hits(part: pd.Series) -> pd.Series:
        out = []
        for text in part:
            rows = []
            for rank, box in enumerate(parse(text).select(".result")):
                link, words = box.first(".result__a"), box.first(".result__snippet")
                if len(rows) < most and link is not None and link.attrs.get("href"):
                    rows.append({"rank": rank, "url": link.attrs["href"], "title": link.text(), "snippet": words.text() if words is not None else ""})
            out.append(rows)
        return pd.Series(out, dtype=object)

    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.explode(hits.asNondeterministic()(F.col(html))).alias("hit")).select(*others, "hit.*")
