"""Contiguous shards of near-equal bytes, cut from global prefix sums.

Rows are dealt into ranges of doc_id; each range is summed; the sums of the
ranges before it give every range its offset, and a running sum inside the
range completes the global prefix sum. The only rows that meet in one place
are the totals, one a partition. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def prefix_sums(sized: DataFrame, order: list[str], size: str) -> DataFrame:
    """sized with `before` (sum of size over the rows before, in the order),
    `number` (rows before), `total` and `n_rows` (over all rows).

    The order's columns must tell rows apart, but for rows that may be
    exchanged; `range_no` and `range_salt` are added columns. The ranges are
    saved, so that the totals and the rows are of the same dealing even when
    an executor is lost.
    """
    salted = sized.withColumn("range_salt", F.rand(7))  # splits rows equal in the whole order
    keys = [*order, "range_salt"]
    ranged = saved(salted.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).withColumn("range_no", F.spark_partition_id()))
    totals = ranged.groupBy("range_no").agg(F.sum(size).alias("s"), F.count("*").alias("n"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    offsets = totals.select(
        "range_no",
        zero(F.sum("s").over(earlier)).alias("offset"),
        zero(F.sum("n").over(earlier)).alias("offset_rows"),
        F.sum("s").over(everything).alias("total"),
        F.sum("n").over(everything).alias("n_rows"),
    )
    inside = Window.partitionBy("range_no").orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return (
        ranged.withColumn("own", zero(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("own_rows", F.row_number().over(inside) - 1)
        .join(offsets, "range_no")
        .withColumn("before", F.col("offset") + F.col("own"))
        .withColumn("number", F.col("offset_rows") + F.col("own_rows"))
        .drop("own", "own_rows", "offset", "offset_rows")
    )


def shards(docs: DataFrame, n_shards: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the carried columns, one row a document.

    Documents stand by doc_id, nulls last, then by checksum. A document goes
    where its middle byte falls among n_shards equal parts of all bytes, so
    that each shard misses its part by half a document at most at either end.
    slot counts from 0 within the shard without gaps. Null texts are one byte,
    with checksum 0. Repeated rows each get a slot. With fewer documents than
    shards some shards stay empty; an empty table gives an empty table.
    """
    extra = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), *extra)
    placed = prefix_sums(sized, ["doc_id", "text_crc32", "size"], "size")
    # floor(n * (2 * before + size) / (2 * total)) in exact integers
    middle = (F.lit(2) * F.col("before") + F.col("size")).cast("decimal(38,0)") * n_shards
    placed = placed.withColumn("middle", middle).withColumn("whole", (F.lit(2) * F.col("total")).cast("decimal(20,0)"))
    shard = F.least(F.expr("cast(middle div whole as int)"), F.lit(n_shards - 1))
    placed = placed.withColumn("shard", shard)
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first_number"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("first_number")).alias("slot"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )
