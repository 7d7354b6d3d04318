"""From classified listings to the files that people work with: status filter,
address tokens, bucket order, contact rows, and what was left out and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from .places import dedupe_by_phone, excluded_by, last_loser

#: States of a business that is no longer met at its address, fixed values.
CLOSED = ("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY")
#: Words of a search that no address has, fixed values.
QUALIFIERS = (
    "θεσσαλονικης", "θεσσαλονικη", "θερμαικου", "θερμαικος", "χαλκιδικης", "ελλαδα", "greece", "thessaloniki",
)
#: Columns of the listings file, fixed values in their order.
LISTING_COLUMNS = (
    "bucket", "relevance", "name", "phone", "address", "website", "website_kind", "specialty", "primary_type", "area", "areas",
    "distance_m", "medical_signal", "rating", "reviews_count", "maps_uri", "place_id",
)
#: Headers of the contact list in their order, and its words for kinds and tiers, fixed values.
LEAD_COLUMNS = (
    "Περιοχή", "Επωνυμία", "Τηλέφωνο", "Διεύθυνση", "Ιστοσελίδα", "Σύνδεσμος", "Ειδικότητα", "Βεβαιότητα", "Σημείωση", "Google Maps",
)
KIND_LABELS = {"none": "Καμία ιστοσελίδα", "directory": "Μόνο χρυσός οδηγός", "social": "Μόνο social media", "booking": "Μόνο πλατφόρμα ραντεβού"}
TIER_LABELS = {"confirmed": "Επιβεβαιωμένο", "review": "Προς έλεγχο"}
MERGED, REPEATED, UNWANTED = "Συγχωνεύτηκε με: ", "διπλότυπο (ίδιο τηλέφωνο)", "εξαιρέθηκε από τον χρήστη"
BUCKETS = ("no_website", "borderline", "has_website")


def is_open(status: Column) -> Column:
    """Whether a listing counts where closed ones are not asked for; an unknown state does."""
    return ~F.upper(F.coalesce(status, F.lit(""))).isin(*CLOSED)


def address_tokens(query: Column) -> Column:
    """What an address would call the place that a search names: its words
    without qualifiers, and with the first of several words as an initial. A
    search of qualifiers alone names the place by them; a blank one, nothing."""
    words = F.filter(F.split(folded(query), r"\s+"), lambda w: w != "")
    own = F.filter(words, lambda w: ~w.isin(*QUALIFIERS))
    own = F.when(F.size(own) > 0, own).otherwise(words)
    whole = F.array_join(own, " ")
    short = F.concat(F.substring(F.get(own, F.lit(0)), 1, 1), F.lit(". "), F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), " "))
    several = (F.size(own) > 1) & (F.length(F.get(own, F.lit(0))) > 1)
    return F.when(F.size(own) > 0, F.when(several, F.array(whole, short)).otherwise(F.array(whole))).otherwise(F.array().cast("array<string>"))


def named(words: dict[str, str], value: Column) -> Column:
    """The label of a value, else the value."""
    return reduce(lambda out, pair: F.when(value == pair[0], pair[1]).otherwise(out), words.items(), value)


def first_area(areas: Column) -> Column:
    return F.coalesce(F.get(areas, F.lit(0)), F.lit(""))


def bucket_order() -> list[Column]:
    """Order of a bucket's listings: first area, distance (none: zero), name."""
    return [first_area(F.col("areas")), F.coalesce("distance_m", F.lit(0.0)), F.col("name")]


def listing_rows(listings: DataFrame) -> DataFrame:
    """The columns of the listings file: areas as one text, distances in whole metres, halves to the even one."""
    made = {"area": first_area(F.col("areas")), "areas": F.array_join("areas", ", "), "distance_m": F.bround("distance_m").cast("long")}
    return listings.select(*[made.get(c, F.col(c)).alias(c) for c in LISTING_COLUMNS])


def listings_file(listings: DataFrame) -> DataFrame:
    """All buckets, one after the other, each in its order."""
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return listing_rows(listings.orderBy(place, *bucket_order()))


def leads(listings: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of the listings to call: excluded names go, then all but
    one listing of a number. kept has `merged`, the last name merged into each
    kept name; dropped is (name, reason)."""
    marked = excluded_by(listings, rules)
    told = F.when(F.col("reason") == "", UNWANTED).otherwise(F.col("reason"))
    merged = dedupe_by_phone(marked.where("reason is null").drop("reason"))
    gone = marked.where("reason is not null").select("name", told.alias("reason"))
    gone = gone.unionAll(merged.where("winner <> place_id").select("name", F.lit(REPEATED)))
    also = last_loser(merged).select(F.col("winner").alias("place_id"), F.col("also").alias("merged"))
    return merged.where("winner = place_id").join(also, "place_id", "left"), gone


def lead_rows(kept: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """The contact list under its headers, by area label and name."""
    area = named(labels or {}, first_area(F.col("areas")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    special = F.coalesce(F.when(F.col("specialty") != "", F.col("specialty")), F.col("primary_type"), F.lit(""))
    cells = (
        area, F.col("name"), text("phone"), text("address"), named(KIND_LABELS, F.col("website_kind")), text("website"), special,
        named(TIER_LABELS, F.col("relevance")), F.coalesce(F.concat(F.lit(MERGED), "merged"), F.lit("")), text("maps_uri"),
    )
    rows = kept.select(*[c.alias(n) for n, c in zip(LEAD_COLUMNS, cells, strict=True)])
    return rows.orderBy(LEAD_COLUMNS[0], LEAD_COLUMNS[1])


def left_out(listings: DataFrame, inside: DataFrame) -> DataFrame:
    """(place_id, reason) of the listings that the area filter drops: no
    coordinates, or in no area."""
    away = listings.join(inside.select("place_id"), "place_id", "left_anti")
    none = F.col("latitude").isNull() | F.col("longitude").isNull()
    return away.select("place_id", F.when(none, "no coordinates").otherwise("outside every area").alias("reason"))


def set_aside(graded: DataFrame) -> DataFrame:
    """The listings that the relevance filter excludes, with the sign that did it."""
    return graded.where("relevance = 'excluded'").select("place_id", "name", F.coalesce(F.when(F.col("medical_signal") != "", F.col("medical_signal")), F.lit("no medical signal")).alias("reason"))


def area_centre(hits: DataFrame, key: str = "area") -> DataFrame:
    """(area, latitude, longitude): the first hit of each with numeric coordinates, by rank."""
    whole = hits.where("latitude is not null and longitude is not null")
    return whole.groupBy(key).agg(F.min_by(F.struct("latitude", "longitude"), "rank").alias("at")).select(key, "at.*")
