"""Format-preserving pseudonyms for personal numbers and dates.

What is found and validated is permuted within its own format by a keyed
Feistel network, so that equal values get equal pseudonyms in all documents
and different values different ones. Column functions only.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session setting that holds the secret key.
KEY_SETTING = "spark.sievework.pii.key"
ROUNDS = 8

#: Kinds in the order they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "date": r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # a card does not end within a social security or phone number
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9]{2}-[0-9]{4}(?![0-9])|[-.][0-9]{3}[-.][0-9]{4}(?![0-9]))",
}
#: What every match has: an at sign, or two digits at most one sign apart.
NEEDED = "@|[0-9][ .-]?[0-9]"
MOST_DIGITS, LEAST_DIGITS = 19, 13
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates lie in this 400-year cycle, whose 146097 days are 189 times 773.
FIRST_DAY, LAST_DAY, LEFT_DAYS, RIGHT_DAYS = "1800-01-01", "2199-12-31", 189, 773


#: Country calling codes of one and two digits, fixed values; all others have three.
ONE_DIGIT, TWO_DIGITS = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Social security numbers: areas 001 to 899 without 666, and groups and
#: serials of which none is all zeros.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def session_key(spark: SparkSession) -> str:
    """The key in the session's KEY_SETTING; where that is unset a fresh one, with
    which values are linked within this run only."""
    return spark.conf.get(KEY_SETTING, None) or token_hex(16)


def _prf(key: str, kind: str, number: Column, value: Column) -> Column:
    """A keyed pseudo-random integer of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column | None = None) -> Column:
    """Struct (a, b): a permutation of the pairs below (left_size, right_size).

    Rounds add a keyed function of one half to the other, modulo its size;
    each is undone by subtracting, so that the whole is one to one.
    """
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def step(pair: Column, number: Column) -> Column:
        a, b = pair["a"], pair["b"]
        own = F.concat_ws("x", number.cast("string"), left_size.cast("string"), right_size.cast("string"), *([] if tweak is None else [tweak]))
        even = number % 2 == 0
        new_a = F.when(even, F.pmod(a + _prf(key, kind, own, b), left_size)).otherwise(a)
        new_b = F.when(even, b).otherwise(F.pmod(b + _prf(key, kind, own, a), right_size))
        return F.struct(new_a.cast("long").alias("a"), new_b.cast("long").alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permuted_digits(key: str, kind: str, digits: Column, tweak: Column | None = None) -> Column:
    """A digit string of up to 30 digits permuted among those of its length, for each tweak in a way of its own."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    halves = F.array(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v))
    size = lambda x: F.pow(F.lit(10), x).cast("long")
    # one-element array: the halves and the permutation are computed once
    made = F.transform(
        F.array(halves),
        lambda h: feistel(key, kind, F.when(h[0] == "", 0).otherwise(h[0].cast("long")), h[1].cast("long"), size(u), size(v), tweak),
    )[0]
    return F.transform(
        F.array(made),
        lambda m: F.concat(F.when(u > 0, F.lpad(m["a"].cast("string"), u, "0")).otherwise(""), F.lpad(m["b"].cast("string"), v, "0")),
    )[0]


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum from the right; a multiple of ten if valid."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["i"] + F.when(digit, 1).otherwise(0)).alias("i"),
        )

    return F.aggregate(F.split(shape, ""), start, step)["s"]


def kind_of(value: Column) -> Column:
    """The kind of a match whose value is valid, else null."""
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    date = F.try_to_date(value, "yyyy-MM-dd")
    octets = F.split(value, r"\.")
    valid_ip = F.forall(octets, lambda x: x.cast("int") <= 255)
    digits = _digits(value)
    return (
        F.when(whole("email"), "email")
        .when(whole("date"), F.when(date.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), "date"))
        .when(whole("ip"), F.when(valid_ip, "ip"))
        .when(whole("phone"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(whole("ssn"), F.when(~digits.rlike("^(000|666|9)|^...00|0000$"), "ssn"))
        .when(whole("card"), F.when(luhn_sum(digits) % 10 == 0, "card"))
    )


def inner_card(value: Column) -> Column:
    """Struct (at, n): place (from 1) and length of the first, then longest run
    of whole pieces of a card match, cut at its spaces and dashes, that is a
    valid card; null if none is."""
    ends = F.filter(F.sequence(F.lit(0), F.length(value)), lambda i: (i == 0) | (i == F.length(value)) | F.substring(value, i + 1, F.lit(1)).isin(" ", "-"))

    def runs(i: Column) -> Column:
        at = F.when(i == 0, 1).otherwise(i + 2)
        longest_first = F.reverse(F.filter(ends, lambda j: j > i))
        made = F.transform(longest_first, lambda j: F.struct(at.alias("at"), (j - at + 1).alias("n")))
        return F.filter(made, lambda r: _valid_card(F.substring(value, r["at"], r["n"])))

    return F.get(F.flatten(F.transform(ends, runs)), F.lit(0))


def _valid_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(LEAST_DIGITS, MOST_DIGITS), luhn_sum(digits) % 10 == 0).otherwise(False)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym within its format."""
    digits = _digits(value)
    # cards: the last digit is the check digit of the others
    front = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    card = F.transform(F.array(front), lambda f: F.concat(f, F.pmod(-luhn_sum(F.concat(f, F.lit("0"))), F.lit(10)).cast("string")))[0]
    # phones: the country code stays, however the number is spelt; ten digits without one are of country 1
    coded = value.startswith("+")
    n = F.when(digits.rlike(f"^{ONE_DIGIT}"), 1).when(digits.rlike(f"^(?:{TWO_DIGITS})"), 2).otherwise(3)
    n = F.when(coded, n).otherwise(0)
    code = F.when(coded, F.substring(digits, F.lit(1), n)).otherwise("1")
    own = permuted_digits(key, "phone", F.substring(digits, n + 1, F.length(digits)), code)
    phone = F.concat(F.substring(digits, F.lit(1), n), own)
    # social security numbers: valid ones are numbered, area by area
    area = F.substring(digits, 1, 3).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    rest = (F.substring(digits, 4, 2).cast("long") - 1) * SERIALS + F.substring(digits, 6, 4).cast("long") - 1
    ssn = F.transform(
        F.array(feistel(key, "ssn", area, rest, F.lit(AREAS), F.lit(GROUPS * SERIALS))),
        lambda p: F.concat(
            F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(p["b"] / SERIALS) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % SERIALS + 1).cast("string"), 4, "0"),
        ),
    )[0]
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    ip = F.transform(
        F.array(feistel(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536))),
        lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256),
    )[0]
    day = F.date_diff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    date = F.transform(
        F.array(feistel(key, "date", F.floor(day / RIGHT_DAYS), day % RIGHT_DAYS, F.lit(LEFT_DAYS), F.lit(RIGHT_DAYS))),
        lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * RIGHT_DAYS + p["b"]).cast("int")), "yyyy-MM-dd"),
    )[0]
    email = F.concat(
        F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 12), F.lit("@"),
        F.substring_index(value, "@", -1),
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "date", date)
        .when(kind == "ip", ip)
        .when(kind == "phone", refill(value, phone))
        .when(kind == "ssn", refill(value, ssn))
        .when(kind == "card", refill(value, card))
        .otherwise(value)
    )


def found_in(match: Column) -> Column:
    """Struct (v, k, before, after): the value of a match, its kind, and what of
    the match stands around it."""
    none, kind = F.lit(""), kind_of(match)
    card = F.when(kind.isNull() & match.rlike(f"^(?:{PATTERNS['card']})$") & match.rlike("[ -]"), inner_card(match))

    def cut(x: Column) -> Column:
        c, end = x["card"], x["card"]["at"] + x["card"]["n"]
        inner = c.isNotNull()
        return F.struct(
            F.when(inner, F.substring(match, c["at"], c["n"])).otherwise(match).alias("v"),
            F.when(inner, "card").otherwise(x["kind"]).alias("k"),
            F.when(inner, F.substring(match, F.lit(1), c["at"] - 1)).otherwise(none).alias("before"),
            F.when(inner, F.substring(match, end, F.length(match))).otherwise(none).alias("after"),
        )

    # one-element array: kind and card are computed once
    return F.get(F.transform(F.array(F.struct(kind.alias("kind"), card.alias("card"))), cut), F.lit(0))


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with its personal values replaced, and n_<kind> for each
    kind, one row a document. key: the secret; without one session_key().

    Cards must pass the Luhn check and keep passing it, octets are 255 at
    most, dates exist and lie in 1800-2199; numbers that fail stay as they
    are. Where digits around a card make the match no card, the card within it
    is taken. Digits move within a value's own layout. Letters cannot be permuted
    among numbers: the local part of an address becomes a keyed digest. A null
    text stays null with zero counts. Repeated rows each give a row; other
    columns are ignored; an empty table gives an empty table. A text is taken
    whole, in time in proportion to its length.
    """
    key = key or session_key(docs.sparkSession)
    text = F.col("text")
    matches = F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = docs.select("doc_id", "text", F.transform(matches, found_in).alias("found"))
    parts = F.split(text, ANY, -1)
    new = F.transform("found", lambda f: F.concat(f["before"], pseudonym(f["v"], f["k"], key), f["after"]))
    rebuilt = F.concat_ws("", F.flatten(F.zip_with(parts, new, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))))
    any_valid = F.exists("found", lambda f: f["k"].isNotNull())
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda f: f["k"] == k)), F.lit(0))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", F.when(any_valid, rebuilt).otherwise(text).alias("text"), *counts)
