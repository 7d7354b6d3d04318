import random
from collections import Counter

import numpy as np

from sievework.llm import decontam

from .cases import PROSE, SCHEMA, edge_frame

ITEM = "item_id long, text string"


def words_of(text):
    return [w for w in (text or "").encode().translate(decontam.ALNUM).decode().split()]


def multiset(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def slow(text, item):
    """Best similarity of any window as long as the item."""
    words, own = words_of(text), words_of(item)
    if not own:
        return 0.0
    width, best = min(5, len(own)), 0.0
    target = multiset(own, width)
    for i in range(len(words) - len(own) + 1):
        window = multiset(words[i : i + len(own)], width)
        shared = sum((window & target).values())
        best = max(best, shared / (sum((window | target).values())))
    return best


def test_finds_what_brute_force_finds():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(rng.randint(15, 60)) for _ in range(30)] + [["tiny"], ["two", "words"], make(400), ["a", "b"] * 20]
    index = decontam.build_index([(i, " ".join(x).encode()) for i, x in enumerate(items)] + [(99, None), (98, b" ,. ")])
    missed = found = 0
    for _ in range(150):
        text = make(rng.randint(20, 200))
        planted = list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):  # words changed, dropped or put in
            at, what = rng.randrange(len(planted)), rng.choice("cdi")
            planted[at : at + (what != "i")] = [] if what == "d" else make(1)
        at = rng.randrange(len(text))
        noisy = rng.choice([" ".join, lambda w: "###, ".join(x.upper() for x in w)])
        text = noisy(text[:at] + planted + text[at:])
        got = {f[0]: f[4] for f in decontam.find(text.encode(), index, decontam.WordHashes())}
        for i, item in enumerate(items):
            best = slow(text, " ".join(item))
            if best >= 0.8:
                found += i in got
                missed += i not in got
                assert i not in got or abs(got[i] - best) < 1e-9
            else:
                assert i not in got
    assert found > 70 and missed <= 0.02 * found, (found, missed)


def test_multi_index_guarantees_the_radius():
    rng = np.random.default_rng(2)
    items = [decontam.Item(i, 10, np.zeros(1, np.uint64), np.ones(1, int), int(x)) for i, x in enumerate(rng.integers(0, 1 << 63, 200, dtype=np.uint64))]
    index = decontam.build_index([])
    fps = np.array([x.fingerprint for x in items], np.uint64)
    index.items = items
    index.tables = []
    for b in range(decontam.BLOCKS):
        keys = ((fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        index.tables.append((np.r_[0, np.cumsum(np.bincount(keys, minlength=1 << 16))], np.argsort(keys, kind="stable")))
    for _ in range(300):
        item = items[rng.integers(200)]
        fp = item.fingerprint
        for b in rng.choice(64, rng.integers(0, decontam.RADIUS + 1), replace=False):
            fp ^= 1 << int(b)
        near = index.near(fp, 10)
        assert {x.item_id for x in near} == {x.item_id for x in items if (x.fingerprint ^ fp).bit_count() <= decontam.RADIUS}


def test_rows_and_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"before {PROSE} after", "en", "a", 1), (2, "something else altogether", "en", "a", 1), (1, f"before {PROSE} after", "en", "a", 1)], SCHEMA)
    items = spark.createDataFrame([(5, PROSE.upper()), (6, PROSE), (7, "not in there at all, this one"), (8, None), (None, PROSE)], ITEM)
    for bound in (20_000, 1):
        monkeypatch.setattr(decontam, "BATCH_ITEMS", bound)
        got = decontam.contaminations(docs, items).collect()
        assert sorted((r.doc_id, r.item_id or -1, r.first_word, r.similarity) for r in got) == [(1, i, 1, 1.0) for i in (-1, -1, 5, 5, 6, 6)]
        kept = decontam.without_benchmark(docs.withColumn("similarity", docs.doc_id), items)
        assert [r.doc_id for r in kept.collect()] == [2] and kept.columns[-1] == "similarity"


def test_edge_cases(spark):
    docs, items = edge_frame(spark), spark.createDataFrame([(1, "nothing of the kind is in these texts"), (2, ""), (3, None)], ITEM)
    assert decontam.contaminations(docs, items).count() == 0
    assert decontam.contaminations(docs.limit(0), items).count() == 0
    assert decontam.contaminations(docs, items.limit(0)).count() == 0
    assert decontam.without_benchmark(docs, items).count() == docs.count()


def test_texts_shorter_than_the_item_are_compared_whole(spark):
    rng = random.Random(6)
    items = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (15, 16, 40, 40, 60, 200)] + [["a", "b"] * 20, ["four", "words", "are", "few"]]
    index = decontam.build_index([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    found = 0
    for i, item in enumerate(items):
        for first in range(6):
            for dropped in range(len(item) // 3):
                text = item[first : len(item) - dropped]
                if len(text) == len(item) or len(text) < 5:
                    continue
                own, part = multiset(item, min(5, len(item))), multiset(text, min(5, len(item)))
                want = sum((own & part).values()) / sum((own | part).values())
                got = {f[0]: f for f in decontam.find(" ".join(text).encode(), index, decontam.WordHashes())}
                assert (i in got) == (want >= 0.8)
                if i in got:
                    found += 1
                    assert got[i][1:4] == (0, len(text), 1) and abs(got[i][4] - want) < 1e-9
    assert found > 100
    docs = spark.createDataFrame([(1, " ".join(items[5][:-5]), "en", "a", 1), (2, " ".join(items[5][:100]), "en", "a", 1)], SCHEMA)
    frame = spark.createDataFrame([(5, " ".join(items[5]))], ITEM)
    assert [(r.doc_id, r.item_id, r.n_words) for r in decontam.contaminations(docs, frame).collect()] == [(1, 5, 195)]
    assert [r.doc_id for r in decontam.without_benchmark(docs, frame).collect()] == [2]
