"""The whole ladder of a page: mappings, map pages from their payloads or from
their own markup, then the stages of extraction; and overlays run on sample pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import Node, parse
from . import extraction as ex
from .maps import at, place_records, search_records, text_at

#: Marks of map pages in URLs, and the kinds of JSON-LD items that are places: fixed values.
PLACE_PAGE, MAP_PAGE, SEARCH = "google.com/maps/place", "google.com/maps", "/search"
LISTING = "business_listing"
PLACE_KINDS = ("Place", "LocalBusiness", "Restaurant")
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
NAME_CHARS, CUT = 200, (("openingHoursSpecification", 200), ("priceRange", 10))
NAMED = "title string, item string, hours string, level string"


def _first_place_item(root: Node) -> dict | None:
    for script in root.select('script[type="application/ld+json"]'):
        try:
            item = json.loads(script.raw())
        except ValueError:
            continue
        if isinstance(item, dict) and item.get("@type") in PLACE_KINDS:
            return item
    return None


def place_markup(html: Column) -> Column:
    """The title of a page and its first JSON-LD item that is a place, as text."""

    @F.pandas_udf(NAMED)
    def read(part: pd.Series) -> pd.DataFrame:
        rows = []
        for text in part:
            root = parse(text)
            title, item = root.first("title"), _first_place_item(root)
            hours, level = (str(item[k])[:most] if item and k in item else None for k, most in CUT)
            rows.append((title.text() if title is not None else None, json.dumps(item) if item else None, hours, level))
        return pd.DataFrame(rows, columns=["title", "item", "hours", "level"])

    return read.asNondeterministic()(html)  # one parse a page


def title_name(title: Column) -> Column:
    """The name in a title: what stands before the first middle dot, else before the last hyphen."""
    dot = F.when(F.contains(title, F.lit("·")), F.substring_index(title, "·", 1))
    hyphen = F.when(F.contains(title, F.lit("-")), F.regexp_extract(title, r"(?s)^(.*)-", 1))
    return F.substring(F.trim(F.coalesce(dot, hyphen)), 1, NAME_CHARS)


def fallback_places(pages: DataFrame) -> DataFrame:
    """Places of pages (page_id, html) by their markup alone: an item of JSON-LD
    has the last word, even without a name; else the title names the place.
    Pages that name none give no row; a null page names none."""
    read = pages.select("page_id", place_markup(F.col("html")).alias("m"))
    read = read.select("page_id", "m.*", F.try_parse_json("m.item").alias("i"))
    i, given = F.col("i"), F.col("i").isNotNull()
    parts = F.array(*(text_at(i, f"$.address.{x}") for x in ADDRESS))
    rows = read.select(
        "page_id", F.when(given, F.coalesce(at(i, "$.name"), F.lit(""))).otherwise(title_name(F.col("title"))).alias("name"),
        F.coalesce(at(i, "$.url"), at(i, "$.sameAs")).alias("website"), F.nullif(F.array_join(F.array_compact(parts), ", "), F.lit("")).alias("address"),
        at(i, "$.telephone").alias("phone"), at(i, "$.aggregateRating.ratingValue", "double").alias("rating"), at(i, "$.aggregateRating.reviewCount", "int").alias("reviews_count"),
        at(i, "$.geo.latitude", "double").alias("latitude"), at(i, "$.geo.longitude", "double").alias("longitude"), F.col("hours").alias("opening_hours"), F.col("level").alias("price_level"),
    )
    return rows.where("name <> ''")


def _as_record(rows: DataFrame, stage: str, ordinal: Column) -> DataFrame:
    data = [c for c in rows.columns if c not in ("page_id", "payload_no", "pos")]
    return rows.select("page_id", F.lit(LISTING).alias("record_type"), F.lit(stage).alias("stage"), ordinal.cast("int").alias("ordinal"), F.to_json(F.struct(*data)).alias("data"))


def ladder_records(pages: DataFrame, payloads: DataFrame, overlays: DataFrame | None = None, schema: list[dict] | None = None) -> DataFrame:
    """(page_id, record_type, stage, ordinal, data) of pages (page_id, url, html,
    status) with the payloads (page_id, payload_no, body) captured with them.

    Mappings come first. A place page gives the first place of its payloads,
    else what its markup names; a search page the businesses of its payloads.
    Pages on which these find nothing, and all others, go on with the overlay
    and the later stages. page_id is unique; null URLs are no map pages;
    failed pages (status 400 or more) give nothing.
    """
    others = ex.record_rows(ex.processed(pages, overlays, schema)).select("page_id", "record_type", "stage", "ordinal", "data")
    kept = pages.where(F.coalesce("status", F.lit(200)) < 400).select("page_id", "url", "html")
    place_pages = kept.where(F.contains("url", F.lit(PLACE_PAGE)))
    search_pages = kept.where(F.contains("url", F.lit(MAP_PAGE)) & F.contains("url", F.lit(SEARCH))).select("page_id")
    of_places = payloads.join(place_pages.select("page_id"), "page_id", "left_semi")
    first = place_records(of_places, keep=("payload_no",)).withColumn("n", F.struct("payload_no"))
    columns = [c for c in first.columns if c not in ("page_id", "n")]
    first = first.groupBy("page_id").agg(F.min_by(F.struct(*columns), "n").alias("p")).select("page_id", "p.*")
    told = fallback_places(place_pages.join(first.select("page_id"), "page_id", "left_anti"))
    places = _as_record(first, "map_place", F.lit(0)).unionByName(_as_record(told, "map_place", F.lit(0)))
    found = search_records(payloads.join(search_pages, "page_id", "left_semi")).join(places.select("page_id"), "page_id", "left_anti")
    mapped = places.unionByName(_as_record(found, "map_search", F.col("pos")))
    if overlays is not None:  # only these hold mappings
        mapped = mapped.join(others.where("stage = 'mappings'").select("page_id").distinct(), "page_id", "left_anti")
    rest = others.join(mapped.select("page_id").distinct(), "page_id", "left_anti")
    if schema is not None:

        @F.pandas_udf("boolean")
        def valid(part: pd.Series) -> pd.Series:
            return part.map(lambda data: ex.is_valid(json.loads(data), schema)).astype(bool)

        mapped = mapped.where(valid("data"))  # a page whose map records are all invalid has none
    return mapped.unionByName(rest)


def _sample_faults(overlay: str | None, html: str | None, fields: list[str]) -> list[tuple[str | None, str]]:
    """(field, fault) of an overlay on a page; field is null where the container or the whole is at fault."""
    text = lambda x: isinstance(x, str) and x.strip()
    try:
        rules = json.loads(overlay or "null")
    except ValueError:
        rules = None
    rules = rules if isinstance(rules, dict) else {}
    container, mappings = rules.get("container_selector"), rules.get("field_mappings")
    if not text(container):
        return [(None, "no_container")]
    if not isinstance(mappings, dict):
        return [(None, "no_fields")]
    out: list[tuple[str | None, str]] = [(f, "missing") for f in sorted(set(fields) - set(mappings))]
    out += [(f, "extra") for f in sorted(set(mappings) - set(fields))]
    root = parse(html)
    try:
        boxes = {id(n) for n in root.select(container)}
    except ValueError:
        return [*out, (None, "container_unparsed")]
    if not boxes:
        return [*out, (None, "container_unresolved")]
    for field, selector in mappings.items():
        if not text(selector):
            out.append((field, "no_selector"))
            continue
        try:
            hits = root.select(selector)
        except ValueError:
            out.append((field, "unparsed"))
            continue
        if not hits:
            out.append((field, "unresolved"))
        elif not all(id(n) in boxes or any(id(up) in boxes for up in n.above()) for n in hits):
            out.append((field, "outside"))
    return out


def sample_faults(samples: DataFrame, fields: list[str]) -> DataFrame:
    """samples (overlay JSON, html and others) without html, one row a fault
    (field, fault); an overlay without a fault gives none and may be stored as a candidate."""

    @F.pandas_udf("array<struct<field:string,fault:string>>")
    def faults(overlay: pd.Series, html: pd.Series) -> pd.Series:
        found = [[{"field": f, "fault": x} for f, x in _sample_faults(o, h, fields)] for o, h in zip(overlay, html, strict=True)]
        return pd.Series(found, dtype=object)

    others = [c for c in samples.columns if c not in ("overlay", "html")]
    return samples.select(*others, F.explode(faults.asNondeterministic()(F.col("overlay"), F.col("html"))).alias("f")).select(*others, "f.*")


def shadow_outputs(pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(domain, role, filled), a row a record, of sample pages (domain, html)
    on which the candidate and the active overlay of their domain are run, in one parse.

    overlays: (domain, state, overlay JSON), one CANDIDATE or SHADOW and at
    most one ACTIVE a domain; other states, and domains without a candidate, run nothing.
    """
    role = F.when(F.col("state").isin("CANDIDATE", "SHADOW"), "candidate").when(F.col("state") == "ACTIVE", "active")
    by_role = overlays.withColumn("role", role).groupBy("domain").agg(
        F.max(F.when(F.col("role") == "candidate", F.col("overlay"))).alias("candidate"), F.max(F.when(F.col("role") == "active", F.col("overlay"))).alias("active")
    )

    @F.pandas_udf("array<struct<role:string,filled:boolean>>")
    def outputs(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, *pair in parts:
            rows = []
            for text, *own in zip(html, *pair, strict=True):
                root = parse(text)
                ran = [(role, ex.records_of(root, json.loads(o))[1]) for role, o in zip(("candidate", "active"), own, strict=True) if o]
                rows.append([{"role": role, "filled": bool(data)} for role, records in ran for _, data in records])
            yield pd.Series(rows, dtype=object)

    met = pages.join(by_role.where("candidate is not null"), "domain")
    rows = met.select("domain", F.explode(outputs.asNondeterministic()(F.col("html"), F.col("candidate"), F.col("active"))).alias("r"))
    return rows.select("domain", "r.*")
