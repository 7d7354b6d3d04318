"""Every operator takes tables whose other columns are named as its own helpers are."""

import corpus_pipeline
from sievework.llm import decontam, licenses, lines, mixing, pii, quality, secrets, sharding, simhash

from .cases import edge_frame, edge_rows

NAMES = (
    "mark node root block blocks lines line_no f s base added draw digest size before total number fp first of_id of_mark own own_mark c0 c1 copies copy epochs "
    "shard slot range_no range_salt carried_0 m g h n a b word_length_high kept base_failed last removed pair key labels v"
).split()


def clashing(spark):
    return edge_frame(spark).selectExpr("*", *[f"{i} as {name}" for i, name in enumerate(NAMES)])


def test_operators(spark):
    docs, n = clashing(spark), len(edge_rows())
    for found in (
        secrets.digest_columns(secrets.secret_spans(docs)), pii.pseudonymised(docs), simhash.simhash_groups(docs), quality.quality_verdicts(docs),
        lines.removals(docs), sharding.shards(docs), mixing.mixed(docs), licenses.license_scan(docs),
    ):
        assert found.count() == n
    items = spark.createDataFrame([(1, "an item of no document at all", 5)], "item_id long, text string, doc_id long")
    assert decontam.contaminations(docs, items).count() == 0


def test_stages_keep_all_columns(spark):
    docs = clashing(spark)
    items = spark.createDataFrame([(1, "an item of no document at all", 5)], "item_id long, text string, c0 long")
    for kept in (quality.keep_good(docs), simhash.keep_first_of_group(docs), decontam.without_benchmark(docs, items), mixing.mixture(docs), lines.without_repeated_lines(docs)):
        assert kept.columns == docs.columns and kept.count() <= 2 * len(edge_rows())
    assert corpus_pipeline.shard(spark, docs, "").count() == len(edge_rows())
