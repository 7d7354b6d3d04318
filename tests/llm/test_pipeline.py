import random

import corpus_pipeline
from sievework.llm import decontam, quality, simhash

from .cases import SCHEMA, edge_frame

SF = "/root/testdata/sf0.001"


def slow_groups(texts):
    """First members of the groups, over all pairs: equal texts and those of shingle similarity 0.8 or more."""
    sets = [set(simhash.own_shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_stages_over_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, SF)
    kept = sorted(r.doc_id for r in good.collect())
    verdicts = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert kept == sorted(i for i, k in verdicts.items() if k) and good.columns == docs.columns

    first = corpus_pipeline.near_dedup(spark, good, SF)
    groups = slow_groups([texts[i] for i in kept])
    unique = sorted(r.doc_id for r in first.collect())
    assert unique == [i for n, i in enumerate(kept) if groups[n] == n] and first.columns == docs.columns

    clean = corpus_pipeline.decontaminate(spark, first, SF)
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontam.build_index(items)
    want = [i for i in unique if not decontam.find(texts[i].encode(), index, decontam.WordHashes())]
    assert sorted(r.doc_id for r in clean.collect()) == want and clean.columns == docs.columns

    mix = corpus_pipeline.mix(spark, clean, SF)
    copies = {}
    for r in mix.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert mix.columns == docs.columns and set(copies) <= set(want) and max(copies.values()) <= 2
    words = lambda i: len(texts[i].encode().split())
    total = sum(map(words, want))
    assert abs(sum(words(i) * n for i, n in copies.items()) - 1.5 * total) < 0.2 * total

    rows = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id] and r.size == len(r.text.encode()) + 1
    assert got == copies
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= 2 * max(r.size for r in rows)


def test_stages_take_edge_cases(spark):
    docs = edge_frame(spark)
    rng = random.Random(1)
    prose = [(100 + i, " ".join(rng.choice(["tion", "the", "of", "er"]) + str(rng.randint(0, 99)) for _ in range(40)), "en", "a", 1) for i in range(5)]
    for frame in (docs, docs.limit(0), docs.union(spark.createDataFrame(prose, SCHEMA))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() >= 0
            if name != "shard":
                assert out.columns == frame.columns
