"""Business listings: union of passes, areas, buckets, and contact lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded

EARTH_M = 6371008.8
M_PER_DEGREE, KM_PER_DEGREE = 111_320.0, 111.32


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def union_of_passes(passes: DataFrame) -> DataFrame:
    """One row a place_id from rows with (seq, area, source): the first row
    counts, later ones fill a missing website or phone; areas and sources are
    listed in the order they came. A place comes up in a few passes at most."""
    first = F.min_by(F.struct("name", "latitude", "longitude", "types"), "seq")
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda x: x["v"]))
    return (
        passes.groupBy("place_id")
        .agg(first.alias("f"), filled("website").alias("website"), filled("phone").alias("phone"), listed("area").alias("areas"), listed("source").alias("sources"))
        .select("place_id", "f.*", "website", "phone", "areas", "sources")
    )


def in_areas(listings: DataFrame, areas: DataFrame) -> DataFrame:
    """Listings inside an area's circle: distance_m of the nearest, and areas
    with those that the address names first.

    A listing meets only the areas that reach into its cell of a grid of one
    degree, so that the join is by equality however many areas there are. A
    circle of any size is in all the cells between its outermost latitudes and
    longitudes; one that takes in a pole is in all longitudes. Listings without
    coordinates, or inside no circle, are not returned: leads.left_out().
    """
    angle = F.col("radius_m") / EARTH_M
    reach = F.degrees(angle) + 1e-6
    polar = F.abs(F.col("area_latitude")) + reach >= 89.9
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.least(angle, F.lit(math.pi / 2))) / F.cos(F.radians("area_latitude"))))) + 1e-6)
    span = lambda mid, d: F.sequence(F.floor(mid - d).cast("int"), F.floor(mid + d).cast("int"))
    spread = areas.withColumn("x", F.explode(span(F.col("area_latitude"), reach)))
    spread = spread.withColumn("y", F.explode(F.array_distinct(F.transform(span(F.col("area_longitude"), wide), lambda y: F.pmod(y, F.lit(360))))))
    placed = listings.where("latitude is not null and longitude is not null")
    placed = placed.withColumn("x", F.floor("latitude").cast("int")).withColumn("y", F.pmod(F.floor("longitude").cast("int"), F.lit(360)))
    distance = haversine_m(F.col("area_latitude"), F.col("area_longitude"), F.col("latitude"), F.col("longitude"))
    inside = placed.join(spread, ["x", "y"]).withColumn("d", distance).where("d <= radius_m")
    named = F.exists("tokens", lambda t: F.contains(folded(F.col("address")), t))
    row = F.struct((~named).alias("by_distance"), F.when(named, 0.0).otherwise(F.col("d")).alias("d"), F.col("area").alias("area"))
    keys = listings.columns
    return inside.groupBy("place_id").agg(
        F.first(F.struct(*[c for c in keys if c != "place_id"])).alias("own"), F.min("d").alias("distance_m"),
        F.array_sort(F.collect_list(row)).alias("found"),  # a few areas
    ).select("place_id", "own.*", "distance_m", F.transform("found", lambda x: x["area"]).alias("in_areas"),
             F.when(F.exists("found", lambda x: ~x["by_distance"]), "address").otherwise("distance").alias("area_source"))


def bucket(kind: Column, social_counts: bool = False, booking_counts: bool = False) -> Column:
    soft = lambda counts: F.lit("no_website" if counts else "borderline")
    return (
        F.when(kind.isin("none", "directory"), "no_website")
        .when(kind == "social", soft(social_counts))
        .when(kind == "booking", soft(booking_counts))
        .otherwise("has_website")
    )


def phone_digits(phone: Column) -> Column:
    """Digits without the international prefix of Greece."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    digits = F.regexp_replace(digits, "^00", "")
    return F.when((F.length(digits) == 12) & digits.startswith("30"), F.substring(digits, 3, 10)).otherwise(digits)


def dedupe_by_phone(listings: DataFrame) -> DataFrame:
    """All listings with `winner`: the place_id that stands for them.

    Of those with one number the richest wins: confirmed first, then the most
    fields, then the longest name, then the earliest. Those without a number
    all stand for themselves.
    """
    filled = sum((F.when(c, 1).otherwise(0) for c in (F.coalesce(F.col("phone"), F.lit("")) != "", F.coalesce(F.col("address"), F.lit("")) != "", F.coalesce(F.col("rating"), F.lit(0.0)) != 0)), F.lit(0))
    rich = F.struct((F.col("relevance") == "confirmed").alias("c"), filled.alias("f"), F.length("name").alias("n"), (-F.col("seq")).alias("s"))
    numbered = listings.withColumn("digits", phone_digits(F.col("phone")))
    winners = numbered.where("digits <> ''").groupBy("digits").agg(F.max_by("place_id", rich).alias("winner"))
    return numbered.join(winners, "digits", "left").withColumn("winner", F.coalesce("winner", "place_id"))


def excluded_by(listings: DataFrame, rules: DataFrame) -> DataFrame:
    """listings with the reason of the first rule whose prefix starts the name.

    rules: (rule_no, prefix, reason). Rules meet names by the prefix's first
    four characters, an equality, before the whole prefix is compared.
    """
    short = F.least(F.length("prefix"), F.lit(4))
    keyed = rules.withColumn("head", F.substring(F.col("prefix"), F.lit(1), short))
    heads = listings.select("place_id", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring(F.col("name"), F.lit(1), n)))).alias("head"))
    hits = heads.join(keyed, "head").where(F.startswith("name", "prefix")).groupBy("place_id").agg(F.min_by("reason", "rule_no").alias("reason"))
    return listings.join(hits, "place_id", "left")


def subdivided(circles: DataFrame, factor: int) -> DataFrame:
    """Each circle (latitude, longitude, radius_m) as factor x factor smaller
    ones that cover it corner to corner."""
    factor = max(2, factor)
    half = F.col("radius_m") / factor
    per_lng = F.greatest(F.lit(1.0), M_PER_DEGREE * F.cos(F.radians("latitude")))
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = circles.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    return rows.withColumn("sub_latitude", F.col("latitude") + (2 * F.col("i") + 1 - factor) * half / M_PER_DEGREE).withColumn(
        "sub_longitude", F.col("longitude") + (2 * F.col("j") + 1 - factor) * half / per_lng
    ).withColumn("sub_radius_m", half * math.sqrt(2))


def grid_steps(lat1: Column, lat2: Column, cell_km: float) -> tuple[Column, Column]:
    """Degrees of a grid cell north and east, for the middle of the box."""
    cell_km = cell_km if cell_km > 0 else 1.0
    cos = F.cos(F.radians((lat1 + lat2) / 2))
    cos = F.when(F.abs(cos) >= 1e-6, cos).when(cos >= 0, 1e-6).otherwise(-1e-6)
    return F.lit(cell_km / KM_PER_DEGREE), cell_km / (KM_PER_DEGREE * cos)


def grid_cells(boxes: DataFrame, cell_km: float = 1.0) -> DataFrame:
    """Centres of the cells of each box (lat1, lng1, lat2, lng2), which must be below the upper bounds."""
    north, east = grid_steps(F.col("lat1"), F.col("lat2"), cell_km)
    count = lambda lo, hi, step: F.greatest(F.lit(0), F.ceil((hi - lo) / step).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    n_lat, n_lng = count(F.col("lat1"), F.col("lat2"), north), count(F.col("lng1"), F.col("lng2"), east)
    rows = boxes.withColumn("estimate", (n_lat * n_lng).cast("long")).select("*", F.explode(upto(n_lat)).alias("i"))
    rows = rows.select("*", F.explode(upto(n_lng)).alias("j"))
    rows = rows.withColumn("lat", F.col("lat1") + (F.col("i") + 0.5) * north).withColumn("lon", F.col("lng1") + (F.col("j") + 0.5) * east)
    return rows.where((F.col("lat") < F.col("lat2")) & (F.col("lon") < F.col("lng2")))


def last_loser(merged: DataFrame) -> DataFrame:
    """(winner, also): the name of the last listing merged into each winner, by seq."""
    return merged.where("winner <> place_id").groupBy("winner").agg(F.max_by("name", "seq").alias("also"))


def top_of(table: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("place", rank).where(F.col("place") <= n)
