import math
import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from sievework.llm import urlrules


def slow_parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def make_url(rng):
    host = rng.choice(["", "www.", "blog.", "WWW.", "notexample."]) + rng.choice(["example.com", "x.example.net", "com", "net", "a.example.org", "spam-farm.example.org", "cheap-pills.example.org", "ÉX.org"])
    path = rng.choice(["", "/", "/en/1", "/es/2.html", "/fr/", "/en", "/de/3"])
    return rng.choice(["https://", "http://", "", "a://b://"]) + host + path + rng.choice(["", "?page=2&ref=x", "#top", "?u=http://x/y#z"])


def test_hosts_paths_and_fixed_rules(spark):
    rng = random.Random(1)
    urls = [make_url(rng) for _ in range(600)] + [None, "", "x", "http://", "http:///p", "http://h\nx/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: r for r in urlrules.url_verdicts(pages, labels).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = slow_parts(url)
        rule, verdict = slow_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url


def test_mined_rules_generalise_and_match_by_brute_force(spark):
    rng = random.Random(2)
    urls = [f"https://{rng.choice(['blog', 'm'])}.{rng.choice(['spam-farm', 'thing', 'other', 'third'])}.example.org/{rng.choice(['en', 'de'])}/{i}" for i in range(3000)]
    bad = ["spam-farm" in u and "/en/" in u for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if i % 3 == 0], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urlrules.url_verdicts(pages, labels).collect()}
    assert got == {i: "block" if b else "allow" for i, b in enumerate(bad)}
    # the pruned rules, matched by the index and by all pairs
    read = pages.select("page_id", urlrules.url_tokens(F.col("url")).alias("tokens"))
    rules = urlrules.mined_rules(read.join(labels, "page_id").select("tokens", "bad"), 0.002, 0.2)
    kept = [(set(r.antecedent), r.confidence, r.anchor) for r in rules.collect()]
    assert kept and all(a in s for s, _, a in kept)
    combos = read.select(F.col("tokens").alias("combo")).distinct()
    fast = {tuple(r.combo): r.confidence for r in urlrules.matched(combos, rules).collect()}
    slow = {}
    for r in combos.collect():
        fits = [c for s, c, _ in kept if s <= set(r.combo)]
        if fits:
            slow[tuple(r.combo)] = max(fits)
    assert fast == slow


def slow_rules(rows, support, confidence):
    """{antecedent: bound} by counting every combination of tokens, one token for those of the same rows."""
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    least = math.ceil(support * len(rows))
    first = {}
    for t in sorted(where):
        if len(where[t]) >= least:
            first.setdefault(frozenset(where[t]), t)
    tokens = sorted(first.values())
    bad = {i for i, (_, b) in enumerate(rows) if b}
    found = {}
    for size in range(1, len(tokens) + 1):
        for own in combinations(tokens, size):
            inside = set.intersection(*(where[t] for t in own))
            k, n = len(inside & bad), len(inside)
            if k >= least and k and k / n >= confidence and k / n >= urlrules.MIN_LIFT * len(bad) / len(rows):
                p, z = k / n, urlrules.Z
                bound = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if bound >= confidence:
                    found[own] = bound
    return {a: c for a, c in found.items() if not any(set(b) < set(a) and d >= c for b, d in found.items())}


def test_rules_equal_enumeration(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        tokens = sorted(t for t in "abcdefgh" if rng.random() < 0.4) + ["all", "every"]
        rows.append((tokens, ("a" in tokens and "b" in tokens and rng.random() < 0.95) or ("c" in tokens and rng.random() < 0.7) or rng.random() < 0.05))
    got = urlrules.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6).collect()
    want = slow_rules(rows, 0.02, 0.6)
    assert len(want) > 2 and {tuple(r.antecedent) for r in got} == set(want)
    assert all(abs(r.confidence - want[tuple(r.antecedent)]) < 1e-9 for r in got)


def test_rules_are_mined_from_the_given_pages(spark):
    """Half of the pages teach; the other half is judged without the fixed rules."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labels = urlrules.rule_labels(pages)
    taught = labels.where("page_id % 2 = 0")
    got = {r.page_id: r.verdict == "block" for r in urlrules.url_verdicts(pages, taught, rules=()).collect()}
    pairs = [(got[r.page_id], r.bad) for r in labels.where("page_id % 2 = 1").collect()]
    hits = sum(a and b for a, b in pairs)
    assert hits > 200 and hits >= 0.95 * sum(a for a, _ in pairs) and hits >= 0.95 * sum(b for _, b in pairs)


def test_a_long_url_counts_whole_and_mines_little(spark):
    url = "http://" + "a-b." * 50 + "example.org/" + "/".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)) + "?" + "&".join(f"k{chr(97 + i)}=1" for i in range(26)) + "#f"
    pages = spark.createDataFrame([(1, url), (2, url), (3, "http://casino.org/play"), (4, "http://x.org/")], "page_id long, url string")
    tokens = pages.select(urlrules.url_tokens(F.col("url")).alias("t")).first().t
    assert "path=xzw" in tokens and "word=xzw" in tokens and "key=kz" in tokens and "query=kz=#" in tokens
    labels = spark.createDataFrame([(1, True), (2, True), (3, False)], "page_id long, bad boolean")
    assert {r.page_id for r in urlrules.url_verdicts(pages, labels).collect()} == {1, 2, 3, 4}


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", "y"), (None, "http://b.net/fr/1", "z"), (2, None, None)], "page_id long, url string, host string")
    assert urlrules.url_verdicts(pages).count() == 4 and urlrules.url_verdicts(pages.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, None), (1, True), (None, True)], "page_id long, bad boolean")
    got = sorted(((r.page_id or -1, r.host, r.verdict) for r in urlrules.url_verdicts(pages, labels).collect()))
    assert got == [(-1, "b.net", "block"), (1, "a.com", "allow"), (1, "a.com", "allow"), (2, "", "allow")]
    assert urlrules.url_verdicts(pages.limit(0), labels.limit(0)).count() == 0
