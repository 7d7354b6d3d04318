"""URL filters: fixed host-and-path rules, and association rules mined from
labelled URLs for all others: what makes a URL one that is blocked. DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Pruning: share of the labelled URLs that have the antecedent and are bad; the
#: share of bad ones among those with the antecedent, as its lower bound at
#: Z standard deviations (Wilson), so that a few URLs prove little; and how
#: much that share exceeds the share of bad URLs in all.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, Z = 0.002, 0.8, 1.2, 1.96
BAD = "label=bad"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of the whole URL, each with its field: labels of
    the host, segments of the path, keys and pairs of the query, and the words
    in labels and segments; runs of digits are #."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    field = lambda name, values: F.transform(values, lambda v: F.when(v != "", F.concat(F.lit(f"{name}="), v)))
    labels, segments, pairs = F.split(host, r"\."), F.split(plain(path), "/"), F.split(plain(query), "&")
    words = lambda x: F.split(plain(x), r"[^\p{L}#]+")
    parts = (
        field("host", labels), field("tld", F.slice(labels, -1, 1)), field("name", words(host)), field("path", segments),
        field("word", words(path)), field("key", F.transform(pairs, lambda x: F.substring_index(x, "=", 1))), field("query", pairs),
        F.array(F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), "fragment=#")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def _one_of_each(labelled: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """(row, items) with one token for all those that stand in the same rows, and
    (token, freq) of those that `least` rows have.

    Tokens of the same rows make the same rules; keeping one keeps the number
    of combinations small, however many tokens a URL has.
    """
    tokens = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    rows = tokens.groupBy("token").agg(
        F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row").bitwiseAND(0xFFFFFFFF)).alias("s")
    )
    kept = saved(rows.where(F.col("freq") >= least).groupBy("freq", "x", "s").agg(F.min("token").alias("token")).select("token", "freq"))
    items = tokens.join(small_side(kept.select("token")), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    return items, kept


def confidence_bound(k: Column, n: Column) -> Column:
    """The lower end of Wilson's interval for k of n."""
    p = k / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support, anchor) of the rules that end in BAD.

    labelled: (tokens array<string>, bad boolean). confidence is the lower
    bound. The anchor is the rarest token of the antecedent: the posting list
    that the rule stands in. A rule goes if a rule on fewer of its tokens is
    as confident. No labelled rows give no rules.
    """
    labelled = saved(labelled.select("tokens", F.coalesce("bad", F.lit(False)).alias("bad"), F.monotonically_increasing_id().alias("row")))
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    items, kept = _one_of_each(labelled, F.ceil(F.lit(min_support * n)))
    marked = items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    # support over all labelled rows, of which some may have no frequent token
    with_items = max(1, marked.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * n / with_items), minConfidence=min_confidence).fit(saved(marked))
    together = F.round(F.col("support") * with_items)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("antecedent"), together.alias("k"), F.round(together / F.col("confidence")).alias("m")
    )
    found = found.withColumn("confidence", confidence_bound(F.col("k"), F.col("m")))
    share = bad / max(1, n)
    rules = saved(found.where((F.col("confidence") >= min_confidence) & (F.col("k") / F.col("m") >= MIN_LIFT * share)).select("antecedent", "confidence", (F.col("k") / max(1, n)).alias("support")))
    posted = rules.select("*", F.explode("antecedent").alias("token")).join(small_side(kept), "token")
    anchored = posted.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    wider = anchored.select(F.col("antecedent").alias("less"), F.col("confidence").alias("as_sure"), F.col("anchor").alias("token"))
    idle = (
        posted.join(wider, "token")
        .where((F.size("less") < F.size("antecedent")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0))
        .select("antecedent")
        .distinct()
    )
    return anchored.join(idle, "antecedent", "left_anti")


def matched(combinations: DataFrame, rules: DataFrame) -> DataFrame:
    """(combo, confidence): the surest rule of each token combination that has one.

    combinations: (combo, an array of tokens). A combination meets only the
    rules whose anchor it has, then must hold the whole antecedent.
    """
    index = rules.select("antecedent", "confidence", F.col("anchor").alias("token"))
    hits = combinations.select("combo", F.explode("combo").alias("token")).join(small_side(index), "token")
    hits = hits.where(F.size(F.array_except("antecedent", "combo")) == 0)
    return hits.groupBy("combo").agg(F.max("confidence").alias("confidence"))


def rule_labels(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, bad): the pages that a fixed rule blocks, against all others."""
    verdict = fixed_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    return pages.select("page_id", F.coalesce(verdict == "block", F.lit(False)).alias("bad"))


def url_verdicts(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES, min_support: float = MIN_SUPPORT) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence, one row a page.

    labels: (page_id, bad), a null label counts as not bad, several of one
    page as bad if one is; without labels the fixed rules give them, so that
    what is mined says by which tokens the blocked URLs are known. A fixed
    rule decides where one fits; else a page is blocked if a mined rule
    matches it, and allowed otherwise. A null url, or one without ://, has an
    empty host and path. Repeated rows each give a row; other columns are
    ignored; an empty table, or one without a bad label, mines nothing. Of a
    URL all tokens count, however long it is.
    """
    url = F.col("url")
    read = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    if labels is None:
        fixed = fixed_rule(F.col("host"), F.col("path"), rules)["verdict"]
        labelled = read.select(url_tokens(url).alias("tokens"), F.coalesce(fixed == "block", F.lit(False)).alias("bad"))
    else:
        known = labels.groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
        labelled = read.join(known, "page_id").select(url_tokens(url).alias("tokens"), "bad")
    mined = saved(mined_rules(labelled, min_support))
    # the tokens of the rules, of which the support bounds the number
    vocabulary = [r.token for r in mined.select(F.explode("antecedent").alias("token")).distinct().collect()]
    tokens = F.array_intersect(url_tokens(url), F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    read = read.withColumn("combo", tokens)
    surest = saved(matched(read.select("combo").distinct(), mined)).withColumnRenamed("combo", "of_combo")
    chosen = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = read.join(small_side(surest), F.col("combo") == F.col("of_combo"), "left").withColumn("fixed", chosen)
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )
