"""The corpus pipeline: from all documents to balanced shards of the mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import dropped, shared_checkpoints, table
from sievework.llm.decontam import without_benchmark
from sievework.llm.mixing import mixture
from sievework.llm.quality import keep_good
from sievework.llm.sharding import shards
from sievework.llm.simhash import keep_first_of_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail, an empty table stays empty."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash finds the close ones, a
    prefix filter on five-word shingles the rest; texts without words, null
    ones among them, are one group."""
    return keep_first_of_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; null and empty texts hold none."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; one without words
    is not taken, null is a source of its own."""
    return mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; a document taken twice has two slots.
    The texts move once, since a shard's documents must come together.
    Fewer documents than shards leave some empty."""
    placed = shards(docs, carry=("text", "lang", "source", "n_chars"))
    return placed.select("doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Near-duplicate groups are the closure of a relation over word hashes that DuckDB has no function for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the
    shared folder before the next reads it, and deleted once that is written.
    The result reads the last but one's, which stays."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if i:
                dropped(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
