"""Spelling variants against a brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sievework.llm import spelling
from sievework.llm.spelling import one_apart, spelling_variants
from tests.llm.cases import edge_frame

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string"


def brute(rows, times=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= 2 and len(w) >= 7}
    spots = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in n}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v, spots)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def one_edit(a, b, spots):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in spots[b] if len(a) < len(b) else b in spots[a]


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_rows():
    """Words of few letters, so that nearly all have neighbours, in chains of rising frequency."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 11))) for _ in range(60)]
    words = list(base)
    for w in base:
        for _ in range(3):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            words.append(w[:i] + ("", rng.choice("abz"), rng.choice("abz") + w[i])[kind] + w[i + 1 :])
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Chained", "chaineß", "chaines", "chainesx"]
    text = []
    for k, w in enumerate(words):
        text += [w] * (2, 2, 30, 3)[k % 4]
    text += ["chaines"] * 500 + ["Chained"] * 8000
    rng.shuffle(text)
    return [(k, " ".join(text[k::17])) for k in range(17)]


def test_variants_equal_brute_force(spark):
    rows = made_rows()
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 5 and any(r[2] not in (r[0], r[1]) for r in want)
    assert found(spelling_variants(spark.createDataFrame(rows, SCHEMA))) == want


def test_long_words_meet_by_their_rests(spark, monkeypatch):
    rng = random.Random(9)
    w = "".join(rng.choice("abcdefgh") for _ in range(48))
    long = "".join(rng.choice("ab") for _ in range(5000))
    words = [w, w + "x", "x" + w, w[:20] + w[21:], w + "y", w[:30] + "z" + w[30:], long, long[:-1], "q" + long[1:], long[:2500] + "b" + long[2500:], "a" * 60, "a" * 61, "b" + "a" * 60]
    rows = [(None, " ".join(words))] * 2
    want = brute(rows)
    assert sum(r[4] for r in want) >= 16
    assert found(spelling_variants(spark.createDataFrame(rows, SCHEMA))) == want
    monkeypatch.setattr(spelling, "LONGEST", 8)  # most of the made words count as long
    rows = made_rows()
    assert found(spelling_variants(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("ab", "abc", True), ("abc", "bc", True), ("aa", "a", True), ("abc", "bca", False), ("abcd", "badc", False), ("", "a", True)])
def test_one_apart(a, b, want):
    assert one_apart(a, b) is want


def test_edge_cases(spark):
    frame = edge_frame(spark)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert found(spelling_variants(frame)) == brute(rows)
    clash = frame.selectExpr("doc_id", "text", "1 as word", "2 as node", "3 as n", "4 as form", "5 as pos", "6 as depth")
    assert found(spelling_variants(clash)) == brute(rows)
    empty = spelling_variants(frame.where("false"))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.isEmpty()
