"""Records from map payloads: nested arrays by position, place objects by name."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_LEVELS = ("Free", "Inexpensive", "Moderate", "Expensive", "Very Expensive")
REVIEWS, REVIEW_CHARS = 10, 2000
#: Levels of objects and lists that are searched for a place.
LEVELS = 5


def at(value: Column, path: str, kind: str = "string") -> Column:
    """A value at a path, null where it is not there or of another type."""
    return F.try_variant_get(value, path, kind)


def text_at(value: Column, path: str, most: int | None = None) -> Column:
    """Trimmed text at a path, null if empty or no text."""
    found = F.when(F.schema_of_variant(at(value, path, "variant")) == "STRING", F.trim(at(value, path)))
    found = F.when(found != "", found)
    return F.substring(found, 1, most) if most else found


def number_at(value: Column, path: str) -> Column:
    """A number at a path, null if it is text."""
    kind = F.schema_of_variant(at(value, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), at(value, path, "double"))


def search_entries(payloads: DataFrame) -> DataFrame:
    """(page_id, pos, entry) of the payload with the most businesses of each
    page, the first of equals. payloads: (page_id, payload_no, body)."""
    body = F.try_parse_json("body")
    outer = F.coalesce(at(body, "$.data", "variant"), body)
    items = F.coalesce(at(outer, "$[0][1]", "array<variant>"), at(outer, "$[0][0][1]", "array<variant>"))
    businesses = F.filter(
        F.transform(F.slice(items, 2, 1_000_000), lambda x: at(x, "$[14]", "variant")),
        lambda b: F.size(at(b, "$", "array<variant>")) > 11,
    )
    counted = payloads.withColumn("found", businesses).where(F.size("found") > 0)
    best = counted.groupBy("page_id").agg(F.max_by("found", F.struct(F.size("found"), -F.col("payload_no"))).alias("found"))
    return best.select("page_id", F.posexplode("found").alias("pos", "entry"))


def search_records(payloads: DataFrame) -> DataFrame:
    """One row a business that has a name."""
    e = F.col("entry")
    rating = number_at(e, "$[4][7]")
    texts = lambda path: F.filter(at(e, path, "array<string>"), lambda x: F.trim(x) != "")
    website = text_at(e, "$[7][0]", 500)
    phone = F.regexp_replace(text_at(e, "$[178][0][0]"), "[ -]", "")
    rows = search_entries(payloads).select(
        "page_id", "pos", text_at(e, "$[11]", 200).alias("name"), text_at(e, "$[0]").alias("place_id"),
        F.substring(F.array_join(texts("$[2]"), ", "), 1, 500).alias("address"),
        F.when(rating.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), rating))).alias("rating"), number_at(e, "$[4][8]").cast("int").alias("reviews_count"),
        F.when(website.startswith("http"), website).alias("website"), number_at(e, "$[9][2]").alias("latitude"), number_at(e, "$[9][3]").alias("longitude"),
        text_at(e, "$[10]").alias("data_id"), F.substring(F.get(texts("$[13]"), F.lit(0)), 1, 100).alias("category"),
        text_at(e, "$[30]", 50).alias("timezone"), text_at(e, "$[34][4][4]", 50).alias("status"), F.substring(phone, 1, 20).alias("phone"),
    )
    return rows.where("name is not null")


def first_place(body: Column) -> Column:
    """JSON text of the first object with place_id and name, in the order of the
    text, at most LEVELS deep; null if there is none or the body cannot be read."""

    def search(text: str | None) -> str | None:
        try:
            todo = [(json.loads(text or "null"), 1)]
        except ValueError:
            return None
        while todo:
            value, level = todo.pop()
            if level > LEVELS:
                continue
            if isinstance(value, dict) and value.keys() >= {"place_id", "name"}:
                return json.dumps(value)
            inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
            todo += [(x, level + 1) for x in reversed(inner)]
        return None

    @F.pandas_udf("string")
    def found(part: pd.Series) -> pd.Series:
        return part.map(search)

    return found.asNondeterministic()(body)  # one search a payload


def place_records(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a payload (page_id, payload_no, body) that holds a place; other columns of it are kept on demand."""
    p = F.try_parse_json(first_place(F.col("body")))
    rows = payloads.withColumn("p", p).where("p is not null")
    p = F.col("p")
    level = at(p, "$.price_level", "int")
    reviews = F.transform(
        F.slice(at(p, "$.reviews", "array<variant>"), 1, REVIEWS),
        lambda r: F.struct(at(r, "$.author_name").alias("author"), at(r, "$.rating", "double").alias("rating"), F.substring(at(r, "$.text"), 1, REVIEW_CHARS).alias("text")),
    )
    return rows.select(
        "page_id", *keep, at(p, "$.place_id").alias("place_id"), at(p, "$.name").alias("name"), at(p, "$.formatted_address").alias("address"),
        at(p, "$.website").alias("website"), at(p, "$.geometry.location.lat", "double").alias("latitude"), at(p, "$.geometry.location.lng", "double").alias("longitude"),
        at(p, "$.rating", "double").alias("rating"), at(p, "$.user_ratings_total", "int").alias("reviews_count"),
        F.coalesce(at(p, "$.formatted_phone_number"), at(p, "$.international_phone_number")).alias("phone"), at(p, "$.types[0]").alias("category"),
        F.array_join(at(p, "$.opening_hours.weekday_text", "array<string>"), ", ").alias("opening_hours"),
        F.coalesce(F.get(F.array(*map(F.lit, PRICE_LEVELS)), level), level.cast("string")).alias("price_level"),
        F.coalesce(at(p, "$.editorial_summary.overview"), at(p, "$.editorial_summary"), at(p, "$.description")).alias("description"),
        F.size(at(p, "$.photos", "array<variant>")).alias("photos_count"), reviews.alias("reviews"),
    )
