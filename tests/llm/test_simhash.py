import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from sievework.llm import bitslice, components, simhash
from sievework.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", None, " \n\t", "One", "a b c", "A b\x0bc\x85d  e F", "x " * 700]
    texts += [" ".join(rng.choice(["the", "Of", "é", "ab", "zz", "q"]) for _ in range(rng.randint(1, 900))) for _ in range(20)]
    for t in texts:
        got = simhash.fingerprint(None if t is None else t.encode())
        assert got % (1 << 64) == slow_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    rows = spark.createDataFrame([("ab c é",)], "t string").select(F.xxhash64("t")).first()
    assert rows[0] % (1 << 64) == xxhash.xxh64_intdigest("ab c é".encode(), 42)


def near(rng, fp, most):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        fp ^= 1 << int(b)
    return fp


def test_kernel_against_popcount():
    rng = np.random.default_rng(3)
    for radius in (1, 3, 4, 9):
        for sizes in ([2, 2, 1], [64, 5, 3, 2], [300], [1, 130, 2, 70]):
            groups = np.repeat(np.arange(len(sizes)), sizes)
            base = [int(x) for x in rng.integers(0, 1 << 63, 5, dtype=np.uint64)]
            fps = np.array([near(rng, base[rng.integers(5)], 7) for _ in groups], np.uint64)
            a, b = bitslice.spanning_links(groups, fps, radius)
            for g in range(len(sizes)):
                own = sorted({int(x) for x in fps[groups == g]})
                want = slow_components(own, lambda x, y: (x ^ y).bit_count() <= radius)
                root = {x: x for x in own}

                def find(x, root=root):
                    while root[x] != x:
                        x = root[x]
                    return x

                for x, y in zip(a, b):
                    x, y = int(x), int(y)
                    if x in root and y in root and want.get(x) == want.get(y):
                        p, q = find(x), find(y)
                        root[max(p, q)] = min(p, q)
                assert {x: find(x) for x in own} == want
            whole = {int(x) for x in fps}
            assert {int(x) for x in a} | {int(x) for x in b} <= whole


def test_links_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    fps = {near(rng, base[rng.integers(40)], 6) for _ in range(600)} | {near(rng, base[0], 3) for _ in range(500)}
    fps = sorted(fps)
    want = slow_components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = bitslice.hamming_links(df, 4, chunk=100)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(links, "a", "b").collect()}
    groups = {}
    for x in fps:
        groups.setdefault(got.get(x, x), set()).add(x)
    wanted = {}
    for x in fps:
        wanted.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_on_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_hubs_have_several_places(spark, monkeypatch):
    """Stars whose centres are linked to each other, larger than one place, and a chain that ends in one."""
    monkeypatch.setattr(components, "PLACE", 16)
    monkeypatch.setattr(components, "AT_ONCE", 64)
    rng = random.Random(8)
    edges = [(centre, 1000 * centre + i) for centre in (5, 3, 4) for i in range(300)] + [(5, 4), (9001, 9000), (9000, 3299), (9001, 9002), (3, 70000), (70000, 4001)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in parent}
    current = spark.range(1, 400).selectExpr("id AS hi", "0L AS lo")
    dealt = components._dealt(current)
    assert dealt.count() == 2 * 399 and dealt.where("key = 0").groupBy("salt").count().agg({"count": "max"}).first()[0] < 40


def edge_rows():
    long = "word " * 60_000
    return [
        (5, "the same text in two rows of this table", "en", "a", 1),
        (3, "the same text in two rows of this table", None, None, None),
        (3, "the same text in two rows of this table", None, None, None),
        (None, "the same text in two rows of this table", "en", "a", 1),
        (7, None, None, None, None),
        (8, "", None, None, None),
        (9, "another text that stands alone here, far away", "en", "b", 2),
        (10, long, "en", "b", 2),
        (None, "alone and without an id, nothing is like it", "en", "b", 2),
    ]


def test_groups_on_edge_cases(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(0))
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by == {5: {3}, 3: {3}, None: {3, None}, 7: {7}, 8: {7}, 9: {9}, 10: {10}}
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_keep_first_keeps_columns_and_one_row_of_each_group(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA).withColumn("own_mark", F.lit(1)).withColumn("first", F.lit(2))
    kept = simhash.keep_first_of_group(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == [(False, x) for x in (3, 7, 9, 10)]
    assert sum(r.doc_id is None for r in rows) == 1
    assert simhash.keep_first_of_group(docs.limit(0)).count() == 0


def test_near_copies_are_one_group_and_others_stay(spark):
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, heads = [], set()
    for k in range(30):
        base = make(300)
        heads.add(100 * k)
        rows.append((100 * k, " ".join(base), "en", "a", 1))
        for i in range(1, 12):  # one word of three hundred changed: similarity 0.97
            words = list(base)
            words[rng.randrange(300)] = "changed"
            rows.append((100 * k + i, " ".join(words), "en", "a", 1))
        rows.append((100 * k + 50, " ".join(base[:150] + make(150)), "en", "a", 1))
        heads.add(100 * k + 50)
    got = {r.doc_id for r in simhash.keep_first_of_group(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert heads <= got and len(got - heads) <= 0.05 * len(rows)


def all_pairs_first(rows):
    """doc_ids of the first members of the groups, by shingle similarity alone."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    root = slow_components(list(sets), linked)
    return {min(x for x in sets if root[x] == r) for r in set(root.values())}


def test_near_copies_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"often{k}" for k in range(30)]  # in most texts
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        if k % 2:
            base[5:5] = passage
        rows.append((10 * k, " ".join(base)))
        for i in range(1, 6):  # about one in fifty words changed, dropped or put in: similarity about 0.8
            words = [w for x in base for w in ([x] if rng.random() > 0.02 else rng.choice([[], ["new", x], ["other"]]))]
            rows.append((10 * k + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    for chunk in (256, 4):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert {r.doc_id for r in simhash.keep_first_of_group(docs).collect()} == all_pairs_first(rows)


def test_simhash_finds_the_close_copies_and_the_prefix_filter_the_rest(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for i, changed in enumerate((0, 1, 6)):  # as it is, a close copy, a far one of similarity 0.81 or more
            words = list(base)
            for at in rng.sample(range(300), changed):
                words[at] = f"new{rng.randrange(3000)}"
            rows.append((10 * k + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in simhash.keep_first_of_group(docs).collect()} == all_pairs_first(rows) == {10 * k for k in range(20)}

    # without the prefix filter the close copies go, and only texts that have one
    monkeypatch.setattr(simhash, "candidate_links", lambda texts, sizes: spark.createDataFrame([], "a long, b long"))
    fps = {i: simhash.fingerprint(t.encode(), simhash.WIDTH) % (1 << 64) for i, t in rows}
    root = slow_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS)
    want = {min(x for x in fps if root[x] == r) for r in set(root.values())}
    assert {r.doc_id for r in simhash.keep_first_of_group(docs).collect()} == want
    assert all_pairs_first(rows) < want < set(fps)


def test_texts_connected_from_the_beginning_are_not_compared(monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "similar", lambda a, b: asked.append(1) or True)
    text = " ".join(f"w{i}" for i in range(50)).encode()
    names = ["g", "lo", "hi", "mark", "own", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([1] * 3, [0] * 3, [0] * 3, [5, 6, 7], [5, 5, 7], [text] * 3)], names)
    got = list(simhash.near_copies(iter([batch])))
    assert len(asked) == 1 and got[0].column("a").to_pylist() == [5] and got[0].column("b").to_pylist() == [7]


def test_stars_need_no_round_and_no_look_for_hubs(spark, monkeypatch):
    """Each round is stages and broadcasts that the driver keeps: a star is settled as it is, and
    one that comes in parts takes no table of hubs."""
    kept = []
    monkeypatch.setattr(components, "saved", lambda df, real=components.saved: kept.append(1) or real(df))
    star = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long").coalesce(1)
    assert {r.root for r in connected_components(star, "a", "b").collect()} == {0} and len(kept) == 1
    kept.clear()
    parts = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 2)], "a long, b long").repartition(4)
    assert {r.root for r in connected_components(parts, "a", "b").collect()} == {2}
    assert len(kept) <= 1 + 3  # the edges, then no more than one table a round


def test_close_links_are_as_few_as_connect(spark):
    """Texts of one fingerprint are a star around the smallest, close fingerprints are linked once, others not at all."""
    texts = spark.createDataFrame([(3, 0), (1, 0), (2, 0), (9, 7), (8, 7), (5, -1), (6, 1 << 40 | 0xFFFFF)], "mark long, fp long")
    links = sorted((min(r.a, r.b), max(r.a, r.b)) for r in simhash.close_links(texts).toDF("a", "b").collect())
    assert sorted(set(links)) == [(1, 2), (1, 3), (1, 8), (8, 9)] and links.count((1, 8)) <= 2
