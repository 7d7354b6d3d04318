"""Queries that run as streams over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as st
from .registry import query


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of each key: with a window as long as the table all repeats go."""
    stream = st.table_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")
    return st.drained(st.deduplicated(stream, ["user_id", "event_type"], "ts", "400 days")).select("user_id", "event_type", F.lit(True).alias("seen"))


@query("SELECT user_id AS root_id, least(count(*), 10) AS granted FROM events GROUP BY 1")
def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children each root is granted by the stateful budget."""
    stream = st.table_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return st.drained(st.granted(stream, "user_id", "event_id")).groupBy(F.col("user_id").alias("root_id")).agg(F.count("*").alias("granted"))


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT user_id, CAST(day AS TIMESTAMP) AS day, n FROM d, m WHERE day + INTERVAL 1 DAY <= mark""")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests a key and day, of the days that the watermark has closed."""
    stream = st.table_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    return st.drained(st.daily_counts(stream, "user_id", "ts")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""SELECT CASE WHEN event_id % 17 = 0 THEN 'unreadable' WHEN event_type <> 'error' THEN 'done' WHEN event_id % 4 >= 2 THEN 'exhausted' ELSE 'retry' END AS fate, count(*) AS n FROM events GROUP BY 1""")
def message_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages done, to be tried again, or dead."""
    key = F.col("event_id")
    text = F.to_json(F.struct(key.cast("string").alias("message_id"), F.lit("task").alias("message_type"), (key % 4).cast("int").alias("retry_count"), F.col("event_type").alias("payload")))
    raw = F.when(key % 17 == 0, "{broken").otherwise(text)
    done, retry, dead = st.split_batch(spark.read.parquet(f"{sf_dir}/events.parquet").select(raw.alias("raw")), F.col("m.payload") == "error")
    fate = lambda df, name: df.select((F.lit(name) if name else F.col("reason")).alias("fate"))
    return fate(done, "done").unionAll(fate(retry, "retry")).unionAll(fate(dead, None)).groupBy("fate").agg(F.count("*").alias("n"))
