"""Queries on the files that are made of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relevance
from ..operators import leads as op
from ..operators import places
from ..sources.tables import load
from .places import AREAS, BUCKET_SQL, DIGITS_SQL, LISTINGS_SQL, SIGNAL_SQL, SPECIALTY_SQL, graded, kind_sql, listings
from .registry import query

STATUSES = ("OPERATIONAL", "CLOSED_TEMPORARILY", None, "closed_permanently")
STATUS_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'OPERATIONAL' WHEN 1 THEN 'CLOSED_TEMPORARILY' WHEN 3 THEN 'closed_permanently' END"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with everything that the files show."""
    key = F.col("place_id")
    table = graded(spark, sf_dir).withColumnRenamed("kind", "website_kind")
    signal = relevance.graded_name(F.col("name"), F.col("types"))["signal"]
    return table.withColumns({
        "bucket": places.bucket(F.col("website_kind")), "medical_signal": signal, "specialty": relevance.specialty(F.col("name"), F.col("display")),
        "primary_type": F.col("display"), "areas": F.array(F.col("area"), F.concat("area", F.lit("b"))), "distance_m": F.when(key % 3 != 0, (key % 700).cast("double") + 0.25),
        "reviews_count": (key % 40).cast("int"), "maps_uri": F.when(key % 2 == 0, F.concat(F.lit("https://maps.example.org/"), key)),
    })


CLASSIFIED_SQL = f"""{LISTINGS_SQL}, k AS (SELECT *, split_part({SIGNAL_SQL}, '|', 1) AS relevance, nullif(split_part({SIGNAL_SQL}, '|', 2), '') AS medical_signal, {kind_sql('website')} AS kind, {SPECIALTY_SQL} AS specialty FROM lst),
cls AS (SELECT *, {BUCKET_SQL} AS bucket, CASE WHEN place_id % 3 <> 0 THEN (place_id % 700) + 0.25::DOUBLE END AS distance_m,
  CASE WHEN place_id % 2 = 0 THEN 'https://maps.example.org/' || place_id END AS maps_uri FROM k)"""


@query(f"SELECT c_custkey AS place_id FROM customer WHERE NOT coalesce(upper({STATUS_SQL}) IN ('CLOSED_PERMANENTLY', 'CLOSED_TEMPORARILY'), false)")
def open_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    status = F.get(F.array(*map(F.lit, STATUSES)), (key % 4).cast("int"))
    return load(spark, sf_dir, "customer").where(op.is_open(status)).select(key.alias("place_id"))


SEARCHES = ("Nea Michaniona Greece", "Thessaloniki", "  ", "Περαία Θεσσαλονίκης", "x Y")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'nea michaniona|n. michaniona' WHEN 1 THEN 'thessaloniki' WHEN 2 THEN '' WHEN 3 THEN 'περαια' ELSE 'x y' END AS tokens FROM supplier""")
def search_address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, SEARCHES)), (F.col("s_suppkey") % 5).cast("int"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(op.address_tokens(text), "|").alias("tokens"))


@query(f"""WITH {CLASSIFIED_SQL}
SELECT bucket, relevance, name, phone, address, website, kind AS website_kind, specialty, display AS primary_type, area, area || ', ' || area || 'b' AS areas,
  CAST(round_even(distance_m, 0) AS BIGINT) AS distance_m, medical_signal, rating, CAST(place_id % 40 AS INTEGER) AS reviews_count, maps_uri, place_id,
  row_number() OVER (PARTITION BY bucket ORDER BY area, coalesce(distance_m, 0), name, place_id) AS place FROM cls""")
def listing_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings file, each row with its place in its bucket."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("bucket").orderBy(*op.bucket_order(), "place_id")
    table = classified(spark, sf_dir)
    placed = table.select(F.col("place_id").alias("of_id"), F.row_number().over(order).cast("long").alias("place"))
    return op.listings_file(table).join(placed, F.col("place_id") == F.col("of_id")).drop("of_id")


LEADS_SQL = f"""{CLASSIFIED_SQL}, src AS (SELECT *, CASE WHEN starts_with(name, 'Φαρμακείο') THEN 'pharmacy' WHEN starts_with(name, 'Dr') THEN '' END AS reason FROM cls WHERE bucket = 'no_website'),
g AS (SELECT *, CASE WHEN length({DIGITS_SQL}) = 12 AND starts_with({DIGITS_SQL}, '30') THEN substr({DIGITS_SQL}, 3) ELSE {DIGITS_SQL} END AS digits FROM src WHERE reason IS NULL),
w AS (SELECT *, CASE WHEN digits = '' THEN place_id ELSE first_value(place_id) OVER (PARTITION BY digits ORDER BY relevance = 'confirmed' DESC,
  CASE WHEN phone <> '' THEN 1 ELSE 0 END + CASE WHEN address <> '' THEN 1 ELSE 0 END + CASE WHEN rating <> 0 THEN 1 ELSE 0 END DESC, length(name) DESC, seq) END AS winner FROM g)"""
RULES = ((1, "Φαρμακείο", "pharmacy"), (2, "Dr", ""))


def _leads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = spark.createDataFrame(list(RULES), "rule_no int, prefix string, reason string")
    return op.leads(classified(spark, sf_dir).where("bucket = 'no_website'"), rules)


@query(f"""WITH {LEADS_SQL}, m AS (SELECT winner AS x, arg_max(name, seq) AS also FROM w WHERE winner <> place_id GROUP BY 1)
SELECT CASE area WHEN 'area0' THEN 'Περαία' ELSE area END AS "Περιοχή", name AS "Επωνυμία", coalesce(phone, '') AS "Τηλέφωνο", coalesce(address, '') AS "Διεύθυνση",
  CASE kind WHEN 'none' THEN 'Καμία ιστοσελίδα' WHEN 'directory' THEN 'Μόνο χρυσός οδηγός' ELSE kind END AS "Ιστοσελίδα", coalesce(website, '') AS "Σύνδεσμος",
  coalesce(nullif(specialty, ''), display, '') AS "Ειδικότητα", CASE relevance WHEN 'confirmed' THEN 'Επιβεβαιωμένο' WHEN 'review' THEN 'Προς έλεγχο' ELSE relevance END AS "Βεβαιότητα",
  coalesce('Συγχωνεύτηκε με: ' || also, '') AS "Σημείωση", coalesce(maps_uri, '') AS "Google Maps" FROM w LEFT JOIN m ON x = place_id WHERE winner = place_id""")
def lead_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact list under its headers."""
    return op.lead_rows(_leads(spark, sf_dir)[0], {"area0": "Περαία"})


@query(f"""WITH {LEADS_SQL}, d AS (SELECT name, CASE WHEN reason = '' THEN 'εξαιρέθηκε από τον χρήστη' ELSE reason END AS reason FROM src WHERE reason IS NOT NULL
  UNION ALL SELECT name, 'διπλότυπο (ίδιο τηλέφωνο)' FROM w WHERE winner <> place_id) SELECT name, reason, count(*) AS n FROM d GROUP BY 1, 2""")
def lead_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contact list leaves out, and why."""
    return _leads(spark, sf_dir)[1].groupBy("name", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {LISTINGS_SQL}, l AS (SELECT place_id, CASE WHEN place_id % 17 <> 0 THEN latitude END AS latitude, longitude FROM lst),
a AS (SELECT * FROM (VALUES (40.5009985::DOUBLE, 22.9257853::DOUBLE, 2000.0::DOUBLE), (40.53, 22.93, 3000.0), (41.9, 24.0, 1000.0), (36.0, 15.0, 850000.0)) AS t(lat, lon, r)),
i AS (SELECT DISTINCT place_id FROM l, a WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) <= r)
SELECT place_id, CASE WHEN latitude IS NULL THEN 'no coordinates' ELSE 'outside every area' END AS reason FROM l WHERE place_id NOT IN (SELECT place_id FROM i)""")
def area_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that no area takes, a circle of 850 km among them."""
    areas = spark.createDataFrame([*AREAS, ("Wide", 36.0, 15.0, 850_000.0, [])], "area string, area_latitude double, area_longitude double, radius_m double, tokens array<string>")
    table = listings(spark, sf_dir).drop("area").withColumn("latitude", F.when(F.col("place_id") % 17 != 0, F.col("latitude")))
    return op.left_out(table, places.in_areas(table, areas))


@query(f"""WITH {CLASSIFIED_SQL} SELECT place_id, name, coalesce(medical_signal, 'no medical signal') AS reason FROM cls WHERE relevance = 'excluded'""")
def relevance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.set_aside(classified(spark, sf_dir))


@query("""WITH h AS (SELECT c_nationkey AS area, c_custkey AS rank, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 100 END AS latitude, CASE WHEN c_custkey % 5 <> 0 THEN 22.0::DOUBLE END AS longitude FROM customer)
SELECT area, arg_min(latitude, rank) AS latitude, arg_min(longitude, rank) AS longitude FROM h WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1""")
def area_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    hits = load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("area"), key.alias("rank"), F.when(key % 3 != 0, F.col("c_acctbal") / 100).alias("latitude"), F.when(key % 5 != 0, 22.0).alias("longitude")
    )
    return op.area_centre(hits)
