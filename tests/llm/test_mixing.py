import random

from sievework.llm import mixing

from .cases import SCHEMA, edge_frame, edge_rows


def slow_targets(sizes):
    """Shares by weight, what is above twice the source shared anew until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
        if not open_:
            return out


def test_targets_match_repeated_sharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i:02}": rng.choice([0, 5, 100, 1000, 20_000]) + 1 for i in range(n)} | ({None: 50} if n > 2 else {})
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def sample(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        rows.append((i, "word " * rng.randint(0, 60) + ("###" if i % 10 == 0 else ""), "en", source, 1))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_taken_words_meet_the_targets(spark):
    rows, docs = sample(spark)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    for source in ("hot", "a", "b", "c", None):
        own = [r for r in got if r.source == source]
        size = sum(r.size for r in own)
        assert all(r.source_size == size for r in own)
        taken, target = sum(r.taken for r in own), own[0].target
        assert abs(taken - target) <= max(r.size for r in own) / 2
        epochs = min(2, int(target // size))
        assert all(r.taken in (epochs * r.size, (epochs + 1) * r.size) and r.taken <= 2 * r.size for r in own)
        # the fraction is a prefix in the order of the draws
        order = [r.taken > epochs * r.size for r in sorted(own, key=lambda r: (r.draw, r.digest)) if r.size]
        assert order == sorted(order, reverse=True)


def test_reruns_and_the_row_form_agree(spark):
    rows, docs = sample(spark)
    one = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    two = {r.doc_id: r.copies for r in mixing.mixed(docs.repartition(13)).collect()}
    assert one == two
    mix = mixing.mixture(docs.withColumn("copies", docs.doc_id))
    assert mix.columns == [*docs.columns, "copies"]
    counts = {}
    for r in mix.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: n for i, n in one.items() if n}


def test_symbols_make_a_document_later(spark):
    rng = random.Random(5)
    rows = [(i, "word " * 20 + ("#" * 20 if i % 2 else ""), "en", "a", 1) for i in range(2000)]
    rows += [(5000, "word " * 5_000, "en", "b", 1)]  # so that source a gives a part of its documents twice
    got = [r for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "a"]
    more = [r.copies for r in got if r.doc_id % 2 == 0], [r.copies for r in got if r.doc_id % 2]
    assert len(set(more[0] + more[1])) > 1 and sum(more[0]) > sum(more[1])


def test_edge_cases(spark):
    got = mixing.mixed(edge_frame(spark)).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert all(r.size == 0 for r in got if r.doc_id in (3, 4, 5))
    assert mixing.mixed(edge_frame(spark).limit(0)).count() == 0
    assert mixing.mixture(edge_frame(spark).limit(0)).count() == 0
