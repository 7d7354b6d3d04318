"""Decisions on fetching, caching, discovery, exploration and promotion, as columns and joins."""

from __future__ import annotations

import ipaddress
import re
import uuid
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import VOID, Node, parse
from ..functions.text import HIDDEN

FRESH_HOURS = 24
BLOCKED_TIER = 0.3
LEAST_ATTEMPTS = 10
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
DEAD_LETTERS = uuid.uuid5(uuid.NAMESPACE_URL, "sievework:dead-letters")
PROMPT_RECORDS, PROMPT_CHARS = 40, 1500
#: Tags and attributes a prompt does without, and with.
DROPPED = frozenset("script style noscript svg canvas iframe template picture source track wbr video audio link meta".split())
KEPT_ATTRIBUTES = frozenset("class id href name role type itemprop itemtype property rel".split())


def cache_decision(force: Column, cached_at: Column, now: Column, etag: Column, status: Column, new_etag: Column) -> Column:
    """Struct (fetch, reason) for a URL, its cache entry (null: none) and the answer to a conditional request."""
    made = lambda fetch, reason: F.struct(F.lit(fetch).alias("fetch"), F.lit(reason).alias("reason"))
    return (
        F.when(force, made(True, "forced"))
        .when(cached_at.isNull(), made(True, "not cached"))
        .when(now - cached_at < F.expr(f"INTERVAL {FRESH_HOURS} HOURS"), made(False, "fresh"))
        .when(status == 304, made(False, "not modified"))
        .when((status == 200) & (new_etag == etag), made(False, "same etag"))
        .when(status == 200, made(True, "changed"))
        .otherwise(made(True, "unexpected answer"))
    )


def first_tier(browser_preferred: Column, block_rate: Column) -> Column:
    return F.when(~browser_preferred & (block_rate < BLOCKED_TIER), "http").otherwise("browser")


def discovered(hits: DataFrame, canonical: Column, denied: Column, blocked: Column, fresh: Column, budget: int) -> DataFrame:
    """hits (plan_id, rank, url) with `reason`, null for those that become tasks.

    The first failing rule counts: a repeat of a better-ranked URL, policy, a
    forbidden address, a fresh cache entry, then the plan's budget by rank.
    Ranks are unique within a plan and not negative.
    """
    marked = hits.withColumn("canonical", canonical)
    best = marked.groupBy("plan_id", "canonical").agg(F.min("rank").alias("best"))
    marked = marked.join(best, ["plan_id", "canonical"])
    reason = F.when(F.col("rank") > F.col("best"), "duplicate").when(denied, "policy_denied").when(blocked, "ssrf_blocked").when(fresh, "cache_fresh")
    marked = marked.withColumn("reason", reason)
    # the rank of the last hit that the budget grants: Spark keeps `budget` rows a plan in each task
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("rank"))
    granted = marked.where("reason is null").select("plan_id", "rank").withColumn("place", place).where(F.col("place") <= budget)
    last = granted.groupBy("plan_id").agg(F.max("rank").alias("last"))
    over = F.when(F.col("rank") > F.coalesce("last", F.lit(-1)), "fanout_budget_exceeded")
    return marked.join(last, "plan_id", "left").withColumn("reason", F.coalesce("reason", over)).drop("best", "last")


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Follow-up URLs of a crawl tree (root, url) that the tree has not had."""
    return found.dropDuplicates(["root", "url"]).join(seen.select("root", "url"), ["root", "url"], "left_anti")


def explored(stats: DataFrame, default: str, draw: Column) -> DataFrame:
    """A choice among the strategies other than the default, the less tried the
    likelier, a tenth as likely where blocked. draw: a number in [0, 1) a domain."""
    missing = F.when(F.col("attempts") < LEAST_ATTEMPTS, F.greatest(F.lit(1.0), F.lit(LEAST_ATTEMPTS) - F.col("attempts"))).otherwise(1.0)
    weight = F.greatest(F.lit(0.01), missing * F.when(F.col("blocked"), 0.1).otherwise(1.0))
    order = Window.partitionBy("domain").orderBy("position")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(Window.partitionBy("domain"))
    rows = stats.where(F.col("strategy") != default).withColumn("weight", weight).withColumn("upto", upto).withColumn("total", total)
    rows = rows.where(F.col("upto") >= draw * F.col("total"))
    return rows.groupBy("domain").agg(F.min_by("strategy", "upto").alias("strategy"))


def shadow_verdicts(outputs: DataFrame, samples: DataFrame) -> DataFrame:
    """Candidate overlays against the active one on the same samples.

    outputs: (domain, role candidate or active, filled boolean), a row a
    record; samples: (domain, n). Records a sample are compared; without a
    candidate record there is no verdict.
    """
    counted = outputs.groupBy("domain").agg(
        F.count_if(F.col("role") == "candidate").alias("c"), F.count_if(F.col("role") == "active").alias("a"), F.count_if((F.col("role") == "candidate") & F.col("filled")).alias("f")
    )
    per = lambda x: F.col(x) / F.greatest(F.col("n"), F.lit(1))
    better = per("c") - per("a")
    verdict = F.when(better > 0.1, "promote").when(better < -0.1, "demote").otherwise("no_change")
    return counted.where("c > 0").join(samples, "domain").select(
        "domain", per("c").alias("precision"), (F.col("f") / F.col("c")).alias("completeness"), F.least(F.lit(1.0), per("c")).alias("score"), verdict.alias("recommendation")
    )


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds, or a date to wait for; never below zero, null if neither."""
    text = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(date) - F.unix_timestamp(now.cast("timestamp"))
    seconds = F.coalesce(text.try_cast("double"), wait.cast("double"))
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def parsed_time(value: Column, default: Column) -> Column:
    """A time in one of five formats, its offset dropped; the default where there is none."""
    plain = F.regexp_replace(value, r"\+.*$", "")
    padded = F.regexp_replace(plain, r"\.(\d{1,6})$", ".$1")
    padded = F.when(plain.rlike(r"\.\d{1,6}$"), F.concat(F.regexp_extract(padded, r"^(.*\.)\d+$", 1), F.rpad(F.regexp_extract(padded, r"\.(\d+)$", 1), 6, "0"))).otherwise(plain)
    tries = [F.try_to_timestamp(padded, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    return F.coalesce(*tries, default)


def private_ip(ip: Column) -> Column:
    """Whether an address must not be reached: private, local, reserved, multicast, or unreadable."""

    @F.pandas_udf("boolean")
    def private(part: pd.Series) -> pd.Series:
        def judged(text: str | None) -> bool:
            try:
                address = ipaddress.ip_address(text)
            except ValueError:
                return True
            address = getattr(address, "ipv4_mapped", None) or address
            return not address.is_global or address.is_multicast or address.is_reserved

        return part.map(judged)

    return private(ip)


def dead_letter_id(row_id: Column, job_id: Column, url: Column, created_at: Column, message: Column) -> Column:
    """A stable id: of the row's own key where it has one, else of four fields that do not change."""

    @F.pandas_udf("string")
    def stable(part: pd.Series) -> pd.Series:
        return part.map(lambda key: str(uuid.uuid5(DEAD_LETTERS, key)))

    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    own = F.concat(F.lit("id:"), row_id.cast("string"))
    return stable(F.coalesce(own, F.concat_ws("|", *map(text, (job_id, url, created_at, message)))))


def prompt_records(records: DataFrame, safe: Column) -> DataFrame:
    """(job_id, prompt_records): the first records of each job as tagged blocks.

    records: (job_id, record_id, created_at, data); safe: the cleaned data text.
    """
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "record_id"))
    block = F.concat(F.lit('<record id="'), F.col("record_id"), F.lit('">\n'), safe, F.lit("\n</record>"))
    kept = records.withColumn("rank", rank).where(F.col("rank") <= PROMPT_RECORDS).withColumn("block", block)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])  # PROMPT_RECORDS at most
    return kept.groupBy("job_id").agg(F.array_join(blocks, "\n").alias("prompt_records"))


def _hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").lower().replace(" ", "")
    return node.tag == "template" or node.attrs.get("aria-hidden", "").strip().lower() == "true" or "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style


def _markup(root: Node, skip, attributes=None, clean=None) -> str:
    """The tree as text again, without the elements that skip names."""
    out: list[str] = []
    todo: list[Node | str] = root.children[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x if x.startswith("</") else escape(clean(x) if clean else x, quote=False))
        elif not skip(x):
            shown = {k: v[:300] for k, v in x.attrs.items() if attributes is None or k in attributes}
            out.append(f"<{x.tag}{''.join(f' {k}="{escape(v)}"' for k, v in shown.items())}>")
            if x.tag not in VOID:
                todo.append(f"</{x.tag}>")
                todo.extend(x.children[::-1])
    return "".join(out)


def visible_html(html: Column) -> Column:
    """Pages without hidden elements, comments and invisible characters."""
    unseen_chars = re.compile(HIDDEN.encode().decode("unicode_escape"))

    @F.pandas_udf("string")
    def visible(part: pd.Series) -> pd.Series:
        return part.map(lambda x: _markup(parse(x), _hidden, clean=lambda t: unseen_chars.sub("", t)))

    return visible(html)


def compact_html(html: Column, most: int = 6000) -> Column:
    """The smallest form of a page that selectors can still be read from, cut to `most`."""

    @F.pandas_udf("string")
    def compact(part: pd.Series) -> pd.Series:
        def short(x: str | None) -> str:
            made = re.sub(r"\s+", " ", _markup(parse(x), lambda n: n.tag in DROPPED, KEPT_ATTRIBUTES)).strip()
            return (made if len(made) <= len(x or "") else x or "")[:most]

        return part.map(short)

    return compact(html)


def overlay_faults(fields: Column, mapped: Column) -> Column:
    """Struct (missing, extra): schema fields an overlay does not map, and the reverse."""
    return F.struct(F.array_sort(F.array_except(fields, mapped)).alias("missing"), F.array_sort(F.array_except(mapped, fields)).alias("extra"))


def profile_axes(value: Column) -> Column:
    """A mixed preference as its fetch tier and its extractor."""
    tier = F.when(value.isin("http", "browser"), value).otherwise("http")
    return F.struct(tier.alias("tier"), F.when(~value.isin("http", "browser"), value).alias("extractor"))
