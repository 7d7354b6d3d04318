import hashlib
import random
from datetime import date

from pyspark.sql import functions as F

from sievework.llm import pii

from .cases import SCHEMA, edge_frame, edge_rows


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def test_permutation_is_one_to_one_in_its_format(spark):
    for n in (1, 2, 3, 4):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        out = [r[0] for r in df.select(pii.permuted_digits("k", "t", F.col("d"))).collect()]
        assert len(set(out)) == 10**n and all(len(x) == n for x in out)
    days = spark.sql("select explode(sequence(date'1999-01-01', date'2004-12-31')) as d").select(F.date_format("d", "yyyy-MM-dd").alias("d"))
    got = [r[0] for r in days.select(pii.pseudonym(F.col("d"), F.lit("date"), "k")).collect()]
    assert len(set(got)) == len(got) == 2192
    assert all(1800 <= date.fromisoformat(x).year <= 2199 for x in got)


def test_values_are_replaced_and_stay_linked(spark):
    card, other = "4785380592391139", "4111 1111 1111 1111"
    assert luhn(card)
    text = f"pay {card}### or {other}, born 1987-02-28, not 1987-02-30; from 152.143.123.131 or 300.1.1.1, call +1 (743) 555-3824 or mail Foo.99@mail5.example.com."
    rows = [(1, text, "en", "a", 1), (2, f"{card} again, and 1234567890123456 is no card", "en", "a", 1)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = got[1].text
    for x in (card, other, "1987-02-28", "152.143.123.131", "555-3824", "Foo.99@"):
        assert x not in one
    for x in ("1987-02-30", "300.1.1.1", "pay ", "### or ", "+1 (", "@mail5.example.com."):
        assert x in one
    assert (got[1].n_card, got[1].n_date, got[1].n_ip, got[1].n_phone, got[1].n_email) == (2, 1, 1, 1, 1)
    new = one[4:20]
    assert new.isdigit() and luhn(new)
    assert got[2].text == f"{new} again, and 1234567890123456 is no card"
    spaced = one[27:46]
    assert spaced.count(" ") == 3 and luhn(spaced.replace(" ", ""))


def test_edge_cases(spark):
    got = pii.pseudonymised(edge_frame(spark)).collect()
    assert sorted((r.text or "") for r in got) == sorted((r[1] or "") for r in edge_rows())
    assert sum(r.text is None for r in got) == 1
    assert all(r.n_card == r.n_ip == r.n_email == 0 for r in got)
    assert pii.pseudonymised(edge_frame(spark).limit(0)).count() == 0


def test_a_value_alone_in_its_text_is_found(spark):
    cases = {
        "ip": ["8.8.8.8", "1.1.1.1"],
        "card": ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"],
        "email": ["a@b.c"],
        "date": ["1987-02-28"],
        "phone": ["+1 (743) 555-3824", "(743) 555-3824", "743.555.3824"],
        "ssn": ["123-45-6789"],
    }
    rows = [(i, f"see {v} here", "en", k, 1) for i, (k, v) in enumerate((k, v) for k, vs in cases.items() for v in vs)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _, kind, _ in rows:
        assert got[i].text != text and got[i][f"n_{kind}"] == 1, text


def test_cards_beside_other_digits(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    texts = [card, spaced, f"{spaced} 123", f"{card} 50", f"12 {card}", f"7-{card}-50", f"{spaced} 123-45-6789", f"{card} {card}", "1234 5678 9012 3456 78"]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    new, wide = got[0].text, got[1].text
    assert new != card and luhn(new) and wide.replace(" ", "") == new
    assert [got[i].text for i in (2, 3, 4, 5, 7, 8)] == [f"{wide} 123", f"{new} 50", f"12 {new}", f"7-{new}-50", f"{new} {new}", texts[8]]
    assert got[6].text.startswith(f"{wide} ") and not got[6].text.endswith("123-45-6789") and got[6].n_ssn == 1
    assert [got[i].n_card for i in range(9)] == [1, 1, 1, 1, 1, 1, 1, 2, 0]


def slow_feistel(key, kind, a, b, m, n, tweak=None):
    """The network in plain Python."""
    for k in range(pii.ROUNDS):
        own = "x".join(map(str, (k, m, n, *([] if tweak is None else [tweak]))))
        f = lambda x: int(hashlib.sha256(f"{key}|{kind}|{own}|{x}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        if k % 2 == 0:
            a = (a + f(b)) % m
        else:
            b = (b + f(a)) % n
    return a, b


def slow_digits(key, kind, digits, tweak=None):
    u, v = len(digits) // 2, len(digits) - len(digits) // 2
    a, b = slow_feistel(key, kind, int(digits[:u] or 0), int(digits[u:]), 10**u, 10**v, tweak)
    return (f"{a:0{u}}" if u else "") + f"{b:0{v}}"


def test_pseudonyms_equal_those_of_plain_python(spark):
    rng = random.Random(3)
    values, want = [], []
    for _ in range(40):
        front = str(rng.randrange(10**14, 10**15))
        card = next(front + str(d) for d in range(10) if luhn(front + str(d)))
        new = slow_digits("k", "card", front)
        values.append((card, "card"))
        want.append(next(new + str(d) for d in range(10) if luhn(new + str(d))))
        area, group, serial = rng.choice([1, 665, 667, 899, rng.randint(1, 665)]), rng.randint(1, 99), rng.randint(1, 9999)
        a, b = slow_feistel("k", "ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        values.append((f"{area:03}-{group:02}-{serial:04}", "ssn"))
        want.append(f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}")
        octets = [rng.randrange(256) for _ in range(4)]
        a, b = slow_feistel("k", "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536)
        values.append((".".join(map(str, octets)), "ip"))
        want.append(f"{a // 256}.{a % 256}.{b // 256}.{b % 256}")
        number = str(rng.randrange(2 * 10**9, 10**10))
        values.append((f"({number[:3]}) {number[3:6]}-{number[6:]}", "phone"))
        new = slow_digits("k", "phone", number, "1")
        want.append(f"({new[:3]}) {new[3:6]}-{new[6:]}")
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(values)], "i int, v string, k string")
    got = [r[1] for r in df.select("i", pii.pseudonym(F.col("v"), F.col("k"), "k")).orderBy("i").collect()]
    assert got == want
    ssns = df.where("k = 'ssn'").select(pii.pseudonym(F.col("v"), F.col("k"), "other").alias("v"))
    assert ssns.where(pii.kind_of(F.col("v")) == "ssn").count() == ssns.count()


def test_spellings_of_one_phone_are_linked(spark):
    texts = ["+15551234567", "+1 555 123 4567", "(555) 123-4567", "555-123-4567", "+1 (555) 123-4567", "+442079460958", "+44 20 7946 0958", "+3530861234567", "+353 0861 234567"]
    rows = [(i, f"call {t} now", "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    digits = {i: "".join(c for c in t if c.isdigit()) for i, t in got.items()}
    assert len({digits[i][-10:] for i in range(5)}) == 1 and digits[0][0] == digits[1][0] == "1" and "5551234567" not in digits[0]
    assert digits[5] == digits[6] != "442079460958" and digits[5][:2] == "44" and digits[7] == digits[8] and digits[7][:3] == "353"


def test_the_key_is_the_callers(spark):
    docs = spark.createDataFrame([(1, "from 8.8.8.8 here", "en", "a", 1)], SCHEMA)
    one = lambda *key: pii.pseudonymised(docs, *key).first().text
    assert one("a") == one("a") != one("b") and one() != one()
    spark.conf.set(pii.KEY_SETTING, "a")
    try:
        assert one() == one("a")
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_columns_of_the_table_may_clash(spark):
    docs = edge_frame(spark).selectExpr("*", "1 as found", "2 as n_ip", "3 as v")
    assert pii.pseudonymised(docs).count() == len(edge_rows())
