"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table that lower-cases A-Z and turns every other ASCII byte outside
#: 0-9a-z into a space; bytes of non-ASCII characters are kept.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset
    a local master gets a temporary folder; a cluster must name one that all
    executors share, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, in the shared folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run, below the shared checkpoint folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def written(df: DataFrame, folder: str, *partitions: str) -> DataFrame:
    """df as a table in a shared folder: cut from its lineage like saved(), but
    compressed, and readable by columns and partitions."""
    df.write.partitionBy(*partitions).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more, on whatever file system it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of 16 MB where the session keeps the
    default of 64 MB, so that a worker holds little at a time. Plans run after
    they are made, so that the setting stays for the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, "16m")


def small_side(df: DataFrame, most: int = 50_000, n: int | None = None) -> DataFrame:
    """df, which is saved, with a broadcast hint if it has `most` rows or fewer;
    beyond that the join shuffles, and adaptive execution splits its hot keys.
    n: the number of rows, where it is known."""
    return F.broadcast(df) if (df.limit(most + 1).count() if n is None else n) <= most else df


#: Bits of a membership filter: sixteen a value, between these bounds (8 KB and 32 MB).
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 28


def membership(values: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of hashes (long), as an array of words.

    Tasks set bits and the words are united before they reach the driver, so
    that MOST_BITS bounds what it gets, however many values there are. With
    more values than it has bits for it lets more rows through, never fewer:
    what it lets through is joined again.
    """
    bits = FEWEST_BITS
    n = values.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    places = F.array(F.col(column), F.shiftrightunsigned(column, 29))
    at = values.select(F.explode(places).alias("h")).select(F.pmod("h", F.lit(bits)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")
    )
    out = np.zeros(bits // 64, np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def is_member(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be in the filter."""
    mask = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.uint64(29)):
        bit = h & mask
        out &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `most` bytes of a binary column, so
    that what is made of a piece stays small; a longer value is a piece of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(upto, most + (upto[first - 1] if first else 0), "right")))
            yield batch.slice(first, last - first)
            first = last
