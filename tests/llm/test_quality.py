import math
import random
import re

from sievework.llm import quality

from .cases import PROSE, SCHEMA, edge_frame, edge_rows


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated |= set(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(lines), len(repeated)


def test_measures_match_the_definition():
    rng = random.Random(6)
    for _ in range(300):
        words = [rng.choice(["a", "the", "é#", "x|y", " z", "q\x85"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            words += words[:20]
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t", "\n\n"]) for w in words)
        assert quality.measure(text.encode()) == slow_measure(text)
    assert quality.measure(None) == (0,) * 6


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["tion", "the", "ing", "an", "er"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(900):
        text = " ".join(word() for _ in range(rng.randint(30, 200)))
        rows.append((i, text, ["en", "de"][i % 2], ["a", "b", "c"][i % 3], 1))
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(50)), "en", "a", 1) for i in range(60)]
    rows += [(2000 + i, "short text", "en", "a", 1) for i in range(5)]
    rows += [(3000, f"{PROSE}\n" * 9, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    clean = {i for i in range(900) if got[i].kept}
    assert len(clean) >= 0.98 * 900, len(clean)  # a quantile fence may lose the odd short document
    assert not any(r.kept for i, r in got.items() if i >= 1000)
    for i, text, *_ in rows:
        r = got[i]
        want = slow_measure(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[5] > 30 * want[0])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean


def frame_of(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, lang string, source string, m struct<{quality.MEASURED.replace(' ', ':').replace(',:', ',')}>")


def test_quantiles_are_within_their_error(spark):
    rng = random.Random(8)
    values = sorted(rng.uniform(2.0, 9.0) for _ in range(1000))
    rows = [(i, "en", "a", (10_000, int(v * 10_000), 0, 0, 1, 0)) for i, v in enumerate(values)]
    got = quality.fences(frame_of(spark, rows)).first()
    q1, q2 = values[249], values[499]
    assert abs(math.log(got.word_length_high) - math.log(q2 * (q2 / q1) ** quality.REACH)) < 4 * quality.ERROR * quality.REACH
    assert abs(math.log(got.word_length_low) - math.log(q2 * (q1 / q2) ** quality.REACH)) < 4 * quality.ERROR * quality.REACH


def test_fences_follow_the_source_and_small_groups_their_language(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source, symbols = ("code", rng.randint(80, 120)) if i % 3 == 0 else ("news", rng.randint(4, 8))
        rows.append((i, "en", source, (300, rng.randint(1300, 1700), symbols, 0, 10, 0)))
    rows.append((9000, "en", "tiny", (300, 1500, 900, 0, 10, 0)))
    rows += [(9100 + i, "en", "news", (5, 10, 10, 0, 1, 0)) for i in range(2000)]  # fail the base rules: count for nothing
    got = {r.source: r for r in quality.fences(frame_of(spark, rows)).collect()}
    assert got["code"].symbol_share_high > 3 * got["news"].symbol_share_high
    # one document hardly moves the quantiles of its language, which stand in for a group as small
    assert got["tiny"].symbol_share_high < 900 / 1500
    docs = {(r.doc_id, r.kept) for r in quality.judged(frame_of(spark, rows), quality.fences(frame_of(spark, rows))).collect()}
    assert (9000, False) in docs and sum(k for _, k in docs) == 3000
    equal = [(i, "en", "a", (100, 500, 0, 0, 1, 0)) for i in range(50)]  # ties: all alike, all stay
    assert all(r.kept for r in quality.judged(frame_of(spark, equal), quality.fences(frame_of(spark, equal))).collect())


def test_columns_of_the_table_may_clash(spark):
    docs = edge_frame(spark).selectExpr("*", "1 as kept", "2 as m", "3 as of_lang", "4 as word_length_high", "5 as measure", "6 as c0")
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_verdicts(docs).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_edge_cases(spark):
    docs = edge_frame(spark)
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(edge_rows())
    assert all(not r.kept for r in got if r.doc_id in (3, 4, 5, 6, 7))
    assert quality.quality_verdicts(docs.limit(0)).count() == 0
    assert quality.keep_good(docs.limit(0)).count() == 0
