import random
import re
import time

import pytest

from sievework.llm import licenses

from .cases import edge_frame, edge_rows


def slow(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_matches_the_definition():
    rng = random.Random(1)
    automaton = licenses.phrase_automaton()
    words = ["mit", "MIT", "license", "License,", "gnu general public license", "apache", "cc", "by", "cc-by", "é", " ", "x", "\x85 ", "GNU General\nPublic  License"]
    for _ in range(3000):
        text = rng.choice(["", " "]).join(f"{rng.choice(words)} " for _ in range(rng.randint(0, 12)))
        got = licenses.scan(text.encode(), automaton)
        assert got[:5] == slow(text)
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
        assert 0 <= got[6] <= 1


def test_expressions():
    assert licenses.to_postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "AND", "OR"]
    assert licenses.to_postfix("(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND ISC") == [
        "MIT", "GPL-2.0-only", "Classpath-exception-2.0", "WITH", "OR", "ISC", "AND"]
    assert licenses.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, 1.0)
    assert licenses.evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl"}, 0.3)
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl"}, 0.6)
    assert licenses.evaluate("MIT is what we chose") == ({"mit"}, 1.0)
    assert licenses.evaluate("MIT and other terms apply") == ({"mit"}, 1.0)
    assert licenses.evaluate("MIT WITH the following conditions") == ({"mit"}, 1.0)
    assert licenses.evaluate("GPL-3.0-only OR mit") == ({"gpl", "mit"}, 1.0)
    for bad in ("", "AND MIT", "(MIT", "MIT OR"):
        with pytest.raises(ValueError):
            licenses.evaluate(bad)


def test_tags_add_labels():
    automaton = licenses.phrase_automaton()
    got = licenses.scan(b"// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-2-Clause\nint x;", automaton)
    assert got[4:] == ("", "bsd,gpl,mit", 1.0)
    assert licenses.scan(b"SPDX-License-Identifier: OR", automaton)[4:] == ("", "", 0.0)


def test_long_texts_take_time_in_proportion():
    automaton, began = licenses.phrase_automaton(), time.time()
    n = 1_700_000  # 10 MB
    assert licenses.scan(b"cc by " * n, automaton)[:4] == (2 * n, n, 0, 2 * n - 2)
    assert time.time() - began < 30


def test_edge_cases(spark):
    got = licenses.license_scan(edge_frame(spark)).collect()
    assert len(got) == len(edge_rows()) and all(r.n_base == 0 and r.first_word is None for r in got)
    want = {r[0]: slow(r[1])[0] for r in edge_rows()}
    assert all(r.n_words == want[r.doc_id] for r in got)
    assert licenses.license_scan(edge_frame(spark).limit(0)).count() == 0
