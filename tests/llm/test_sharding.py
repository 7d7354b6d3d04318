import random
import zlib

from sievework.llm import sharding

from .cases import SCHEMA, edge_frame, edge_rows


def test_bytes_are_balanced_and_contiguous(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 400) if i % 9 else None, "en", "a", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r for r in sharding.shards(docs, carry=("lang",)).collect()}
    sizes = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    total, before, loads = sum(sizes.values()), 0, [0] * 8
    for i, t, *_ in rows:  # brute force over the rows in order
        r = got[i]
        assert (r.size, r.text_crc32, r.lang) == (sizes[i], zlib.crc32((t or "").encode()), "en")
        assert r.shard == 8 * (2 * before + sizes[i]) // (2 * total)
        before += sizes[i]
        loads[r.shard] += sizes[i]
    assert max(loads) - min(loads) <= 2 * max(sizes.values())
    for s in range(8):
        own = [got[i].slot for i in sorted(got) if got[i].shard == s]
        assert own == list(range(len(own)))


def test_prefix_sums(spark):
    rows = [(i % 7, i) for i in range(500)]
    got = sharding.prefix_sums(spark.createDataFrame(rows, "k long, v long"), ["k", "v"], "v").collect()
    before = 0
    for n, (k, v) in enumerate(sorted(rows)):
        r = next(x for x in got if (x.k, x.v) == (k, v))
        assert (r.before, r.number, r.total, r.n_rows) == (before, n, sum(range(500)), 500)
        before += v


def test_edge_cases(spark):
    got = sharding.shards(edge_frame(spark)).collect()
    assert len(got) == len(edge_rows()) and {r.shard for r in got} <= set(range(8))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shards(edge_frame(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(1, "equal text", "en", "a", 1)] * 400, SCHEMA)
    assert sorted((r.shard, r.slot) for r in sharding.shards(same).collect()) == [(s, n) for s in range(8) for n in range(50)]
