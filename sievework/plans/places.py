"""Queries on business listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relevance, web
from ..operators import places as op
from ..sources.tables import load, pick
from .registry import query

NAMES = ("Ορθοπαιδικός Παπάς", "Φαρμακείο", "Dr Smith", "Κτηνιατρείο", "Καφέ Κέντρο", "Medical Center", "ΟΔΟΝΤΙΑΤΡΕΙΟ", "Ιατρός")
WEBSITES = (None, "vrisko.gr/x", "https://www.facebook.com/x", "doctoranytime.gr/x", "https://own.gr", "n/a")
TYPES = {"AUTOMOBILE": "store", "BUILDING": "doctor", "FURNITURE": "medical_clinic", "HOUSEHOLD": "health,pharmacy", "MACHINERY": "locality"}
DISPLAYS = ("Νοσοκομείο", "health", "Κέντρο Ομορφιάς", "")
AREAS = (("Peraia", 40.5009985, 22.9257853, 2000.0, ["peraia"]), ("Epanomi", 40.53, 22.93, 3000.0, ["epanomi", "d1"]), ("Far", 41.9, 24.0, 1000.0, ["far"]))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    number = F.lpad((key % 97).cast("string"), 4, "0")
    phone = F.when(key % 3 == 0, F.concat(F.lit("239202"), number)).when(key % 3 == 1, F.concat(F.lit("2392 02"), number)).otherwise(F.concat(F.lit("+30 2392 02"), number))
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("c_mktsegment")]
    return load(spark, sf_dir, "customer").select(
        key.alias("place_id"),
        key.alias("seq"),
        F.concat_ws(" ", pick(NAMES, key % 8), F.when(key % 2 == 0, F.col("c_name"))).alias("name"),
        F.when(key % 13 != 0, phone).alias("phone"),
        pick(WEBSITES, key % 6).alias("website"),
        F.when(key % 5 != 0, F.concat(F.lit("Street D"), key % 4)).alias("address"),
        (40.50 + (key % 100) / 1000).alias("latitude"),
        (22.92 + (key % 50) / 1000).alias("longitude"),
        F.split(types, ",").alias("types"),
        F.when(key % 4 == 0, F.col("c_acctbal")).alias("rating"),
        pick(DISPLAYS, key % 4).alias("display"),
        F.concat(F.lit("area"), key % 3).alias("area"),
        F.concat(F.lit("pass"), key % 2).alias("source"),
    )


def _case(values, expr: str) -> str:
    text = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {text(v)}" for k, v in values) + " END"


LISTINGS_SQL = f"""
lst AS (SELECT c_custkey AS place_id, c_custkey AS seq, {_case(enumerate(NAMES), 'c_custkey % 8')} || CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_name ELSE '' END AS name,
  CASE WHEN c_custkey % 13 <> 0 THEN CASE c_custkey % 3 WHEN 0 THEN '239202' WHEN 1 THEN '2392 02' ELSE '+30 2392 02' END || lpad(CAST(c_custkey % 97 AS VARCHAR), 4, '0') END AS phone,
  {_case(enumerate(WEBSITES), 'c_custkey % 6')} AS website, CASE WHEN c_custkey % 5 <> 0 THEN 'Street D' || (c_custkey % 4) END AS address,
  40.50 + (c_custkey % 100) / 1000.0::DOUBLE AS latitude, 22.92 + (c_custkey % 50) / 1000.0::DOUBLE AS longitude,
  string_split({_case([("'" + k + "'", v) for k, v in TYPES.items()], 'c_mktsegment')}, ',') AS types,
  CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS rating, {_case(enumerate(DISPLAYS), 'c_custkey % 4')} AS display,
  'area' || (c_custkey % 3) AS area, 'pass' || (c_custkey % 2) AS source FROM customer)
"""
quoted = lambda values: ", ".join("'" + v + "'" for v in values)
FOLD_SQL = "strip_accents(lower(name))"
STEM_SQL = "|".join(relevance.NAME_STEMS).replace("(?<!κτην)", "")  # names with that stem are decided before
SIGNAL_SQL = f"""CASE WHEN contains({FOLD_SQL}, 'κτηνιατρ') THEN 'excluded|name:κτηνιατρ'
 WHEN regexp_extract({FOLD_SQL}, '{STEM_SQL}') <> '' THEN 'confirmed|name:' || regexp_extract({FOLD_SQL}, '{STEM_SQL}')
 WHEN len(list_filter(types, lambda t: t IN ({quoted(relevance.MEDICAL_TYPES)}))) > 0 THEN 'confirmed|type:' || list_filter(types, lambda t: t IN ({quoted(relevance.MEDICAL_TYPES)}))[1]
 WHEN len(list_filter(types, lambda t: t IN ({quoted(relevance.OTHER_TYPES)}))) > 0 THEN 'excluded|type:' || list_filter(types, lambda t: t IN ({quoted(relevance.OTHER_TYPES)}))[1]
 WHEN len(list_filter(types, lambda t: t IN ({quoted(relevance.UNCLEAR_TYPES)}))) > 0 THEN 'review|type:' || list_filter(types, lambda t: t IN ({quoted(relevance.UNCLEAR_TYPES)}))[1]
 ELSE 'excluded|' END"""
HOST_SQL = "lower(regexp_extract(regexp_replace({u}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '^([^/?#:]*)', 1))"


def kind_sql(url: str) -> str:
    host = HOST_SQL.format(u=url)
    under = lambda domains: f"regexp_matches({host}, '(^|\\.)({'|'.join(d.replace('.', chr(92) + '.') for d in domains)})$')"
    return f"""CASE WHEN {url} IS NULL OR NOT regexp_matches({host}, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') THEN 'none' WHEN {under(web.DIRECTORIES)} THEN 'directory'
      WHEN {under(web.SOCIAL)} THEN 'social' WHEN {under(web.BOOKING)} THEN 'booking' ELSE 'own' END"""


BUCKET_SQL = "CASE WHEN kind IN ('none', 'directory') THEN 'no_website' WHEN kind IN ('social', 'booking') THEN 'borderline' ELSE 'has_website' END"


@query(f"""WITH {LISTINGS_SQL}, k AS (SELECT 'listing' AS origin, place_id AS id, {kind_sql('website')} AS kind FROM lst UNION ALL SELECT 'page', page_id, {kind_sql('url')} FROM pages)
SELECT origin, id, kind, {BUCKET_SQL} AS bucket, kind IN ('none', 'directory', 'social', 'booking') AS lacks_website FROM k""")
def website_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    own = listings(spark, sf_dir).select(F.lit("listing").alias("origin"), F.col("place_id").alias("id"), web.website_kind(F.col("website")).alias("kind"))
    pages = load(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), web.website_kind(F.col("url")).alias("kind"))
    return own.unionByName(pages).select("origin", "id", "kind", op.bucket(kind).alias("bucket"), web.lacks_website(kind).alias("lacks_website"))


@query(f"""WITH {LISTINGS_SQL}, p AS (SELECT *, place_id // 3 AS pid FROM lst)
SELECT pid AS place_id, arg_min(name, seq) AS name, arg_min(website, seq) FILTER (WHERE website <> '') AS website, arg_min(phone, seq) FILTER (WHERE phone <> '') AS phone,
  array_to_string(list(area ORDER BY seq), ',') AS areas, array_to_string(list_distinct_keep, ',') AS sources
FROM (SELECT *, NULL AS x FROM p) JOIN (SELECT pid AS q, CASE WHEN count(DISTINCT source) = 1 THEN [min(source)] ELSE [arg_min(source, seq), CASE arg_min(source, seq) WHEN 'pass0' THEN 'pass1' ELSE 'pass0' END] END AS list_distinct_keep FROM p GROUP BY 1) ON q = pid
GROUP BY 1, list_distinct_keep""")
def listing_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes find each place: the first row counts, later ones fill gaps."""
    passes = listings(spark, sf_dir).withColumn("place_id", F.floor(F.col("place_id") / 3).cast("long"))
    table = op.union_of_passes(passes)
    return table.select("place_id", "name", "website", "phone", F.array_join("areas", ",").alias("areas"), F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {LISTINGS_SQL}, a AS (SELECT * FROM (VALUES ('Peraia', 40.5009985::DOUBLE, 22.9257853::DOUBLE, 2000.0::DOUBLE, ['peraia']), ('Epanomi', 40.53, 22.93, 3000.0, ['epanomi', 'd1']), ('Far', 41.9, 24.0, 1000.0, ['far'])) AS t(area, lat, lon, r, tokens)),
d AS (SELECT place_id, a.area, tokens, address, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) AS d, r FROM lst, a),
n AS (SELECT place_id, area, d, coalesce(len(list_filter(tokens, lambda t: contains(strip_accents(lower(address)), t))) > 0, false) AS named FROM d WHERE d <= r)
SELECT place_id, round(min(d), 3) AS distance_m, array_to_string(list(area ORDER BY NOT named, CASE WHEN named THEN 0 ELSE d END, area), ',') AS in_areas, CASE WHEN bool_or(named) THEN 'address' ELSE 'distance' END AS area_source FROM n GROUP BY 1""")
def area_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.createDataFrame(list(AREAS), "area string, area_latitude double, area_longitude double, radius_m double, tokens array<string>")
    table = op.in_areas(listings(spark, sf_dir).drop("area"), areas)
    return table.select("place_id", F.round("distance_m", 3).alias("distance_m"), F.array_join("in_areas", ",").alias("in_areas"), "area_source")


@query(f"""WITH {LISTINGS_SQL}, s AS (SELECT place_id, {SIGNAL_SQL} AS v FROM lst)
SELECT place_id, split_part(v, '|', 1) AS tier, nullif(split_part(v, '|', 2), '') AS signal, split_part(v, '|', 1) <> 'excluded' AS medical FROM s""")
def relevance_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = relevance.graded_name(F.col("name"), F.col("types"))
    table = listings(spark, sf_dir).select("place_id", signal.alias("s"))
    return table.select("place_id", "s.tier", "s.signal", (F.col("s.tier") != "excluded").alias("medical"))


SPECIALTY_SQL = (
    "CASE " + " ".join(f"WHEN contains({FOLD_SQL}, '{stem}') THEN '{label}'" for stem, label in relevance.SPECIALTIES)
    + " " + " ".join(f"WHEN lower(display) = '{k}' THEN '{v}'" for k, v in relevance.DISPLAY_ALIASES.items())
    + f" WHEN display <> '' AND lower(display) NOT IN ({quoted(relevance.DISPLAY_NOISE)}) THEN display "
    + " ".join(f"WHEN contains({FOLD_SQL}, '{s}') THEN '{relevance.GENERIC_LABEL}'" for s in relevance.GENERIC_STEMS) + " END"
)


@query(f"WITH {LISTINGS_SQL} SELECT place_id, {SPECIALTY_SQL} AS specialty FROM lst")
def specialty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("place_id", relevance.specialty(F.col("name"), F.col("display")).alias("specialty"))


DIGITS_SQL = "regexp_replace(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), '^00', '')"
WINNERS_SQL = f"""
g AS (SELECT *, split_part({SIGNAL_SQL}, '|', 1) AS relevance, {kind_sql('website')} AS kind, CASE WHEN length({DIGITS_SQL}) = 12 AND starts_with({DIGITS_SQL}, '30') THEN substr({DIGITS_SQL}, 3) ELSE {DIGITS_SQL} END AS digits FROM lst),
w AS (SELECT *, CASE WHEN digits = '' THEN place_id ELSE first_value(place_id) OVER (PARTITION BY digits ORDER BY relevance = 'confirmed' DESC,
  CASE WHEN phone <> '' THEN 1 ELSE 0 END + CASE WHEN address <> '' THEN 1 ELSE 0 END + CASE WHEN rating <> 0 THEN 1 ELSE 0 END DESC, length(name) DESC, seq) END AS winner FROM g)
"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = listings(spark, sf_dir)
    signal = relevance.graded_name(F.col("name"), F.col("types"))["tier"]
    return table.withColumn("relevance", signal).withColumn("kind", web.website_kind(F.col("website")))


@query(f"WITH {LISTINGS_SQL}, {WINNERS_SQL} SELECT place_id, digits, winner FROM w")
def phone_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedupe_by_phone(graded(spark, sf_dir)).select("place_id", "digits", "winner")


@query(f"""WITH {LISTINGS_SQL}, {WINNERS_SQL.replace('FROM lst)', "FROM lst WHERE NOT starts_with(name, 'Φαρμακείο') AND NOT starts_with(name, 'Dr'))").replace('FROM g)', "FROM g WHERE kind IN ('none', 'directory', 'social', 'booking'))")}
SELECT place_id, name, digits, {BUCKET_SQL} AS bucket, relevance, m.also FROM w LEFT JOIN (SELECT winner AS x, arg_max(name, seq) AS also FROM w WHERE winner <> place_id GROUP BY 1) m ON m.x = w.place_id WHERE winner = place_id""")
def lead_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact list: excluded names go, one listing a number stays and names the last one merged into it."""
    rules = spark.createDataFrame([(1, "Φαρμακείο", "pharmacy"), (2, "Dr", "by request")], "rule_no int, prefix string, reason string")
    source = graded(spark, sf_dir).withColumn("bucket", op.bucket(F.col("kind"))).where("bucket <> 'has_website'")
    kept = op.excluded_by(source, rules).where("reason is null")
    merged = op.dedupe_by_phone(kept)
    losers = op.last_loser(merged).withColumnRenamed("winner", "place_id")
    return merged.where("winner = place_id").join(losers, "place_id", "left").select("place_id", "name", "digits", "bucket", "relevance", "also")


@query("""WITH b AS (SELECT s_suppkey, 40.0 + (s_suppkey % 10) / 100.0::DOUBLE AS latitude, 22.0 + (s_suppkey % 7) / 100.0::DOUBLE AS longitude, 500.0 + s_suppkey AS radius_m FROM supplier),
c AS (SELECT s_suppkey, i, j, latitude + (2 * i + 1 - 3) * (radius_m / 3) / 111320.0 AS sub_latitude, longitude + (2 * j + 1 - 3) * (radius_m / 3) / greatest(1.0, 111320.0 * cos(radians(latitude))) AS sub_longitude, radius_m / 3 * sqrt(2) AS sub_radius_m
  FROM b, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j))
SELECT s_suppkey, i, j, round(sub_latitude, 9) AS sub_latitude, round(sub_longitude, 9) AS sub_longitude, round(sub_radius_m, 6) AS sub_radius_m FROM c""")
def circle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    circles = load(spark, sf_dir, "supplier").select(key, (40.0 + (key % 10) / 100).alias("latitude"), (22.0 + (key % 7) / 100).alias("longitude"), (500.0 + key).alias("radius_m"))
    table = op.subdivided(circles, 3)
    return table.select("s_suppkey", "i", "j", F.round("sub_latitude", 9).alias("sub_latitude"), F.round("sub_longitude", 9).alias("sub_longitude"), F.round("sub_radius_m", 6).alias("sub_radius_m"))


@query("""WITH b AS (SELECT s_suppkey, 40.0 + (s_suppkey % 10) / 100.0::DOUBLE AS lat1, 22.0::DOUBLE AS lng1 FROM supplier), s AS (SELECT *, lat1 + 0.05 AS lat2, lng1 + 0.04 AS lng2, 1.0 / 111.32 AS north, 1.0 / (111.32 * cos(radians((lat1 + lat1 + 0.05) / 2))) AS east FROM b),
c AS (SELECT *, ceil((lat2 - lat1) / north)::INT AS nlat, ceil((lng2 - lng1) / east)::INT AS nlng FROM s), r AS (SELECT *, unnest(range(nlat)) AS i FROM c), q AS (SELECT *, unnest(range(nlng)) AS j FROM r)
SELECT s_suppkey, nlat::BIGINT * nlng AS estimate, i::INT AS i, j::INT AS j, round(lat1 + (i + 0.5) * north, 9) AS lat, round(lng1 + (j + 0.5) * east, 9) AS lon FROM q WHERE lat1 + (i + 0.5) * north < lat2 AND lng1 + (j + 0.5) * east < lng2""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    boxes = load(spark, sf_dir, "supplier").select(key, (40.0 + (key % 10) / 100).alias("lat1"), F.lit(22.0).alias("lng1"))
    boxes = boxes.withColumn("lat2", F.col("lat1") + 0.05).withColumn("lng2", F.col("lng1") + 0.04)
    return op.grid_cells(boxes).select("s_suppkey", "estimate", "i", "j", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"""WITH {LISTINGS_SQL}, k AS (SELECT *, split_part({SIGNAL_SQL}, '|', 1) AS relevance, {kind_sql('website')} AS kind FROM lst), b AS (SELECT *, {BUCKET_SQL} AS bucket FROM k)
SELECT area, count(*) AS total, count(*) FILTER (WHERE bucket = 'no_website') AS no_website, count(*) FILTER (WHERE bucket = 'borderline') AS borderline, count(*) FILTER (WHERE bucket = 'has_website') AS has_website,
  count(*) FILTER (WHERE bucket = 'no_website' AND phone IS NOT NULL) AS callable, count(*) FILTER (WHERE relevance = 'confirmed') AS confirmed, count(*) FILTER (WHERE relevance = 'review') AS needs_review FROM b GROUP BY 1""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = graded(spark, sf_dir).withColumn("bucket", op.bucket(F.col("kind")))
    counted = {
        "no_website": "bucket = 'no_website'", "borderline": "bucket = 'borderline'", "has_website": "bucket = 'has_website'",
        "callable": "bucket = 'no_website' and phone is not null", "confirmed": "relevance = 'confirmed'", "needs_review": "relevance = 'review'",
    }
    return table.groupBy("area").agg(F.count("*").alias("total"), *[F.count_if(F.expr(c)).alias(k) for k, c in counted.items()])
