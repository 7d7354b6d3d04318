"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of profiles that are no site of the business's own, fixed values.
DIRECTORIES = (
    "vrisko.gr", "xo.gr", "chrysosodigos.gr", "goldenpages.gr", "yellowpages.gr", "11888.gr", "11880.gr", "wowpages.gr",
    "b2bgreece.gr", "greekbusiness.gr", "cylex.gr", "cylex-greece.com", "tuugo.gr", "europages.gr", "europages.com",
    "yelp.com", "yellowpages.com", "foursquare.com", "tripadvisor.com", "tripadvisor.com.gr", "enrollbusiness.com",
    "opendi.gr", "infoisinfo.gr", "hotfrog.gr", "business.site",
)
SOCIAL = (
    "facebook.com", "fb.com", "fb.me", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com",
    "pinterest.com", "wa.me", "t.me",
)
BOOKING = (
    "doctoranytime.gr", "doctoranytime.com", "iatronet.gr", "iatropedia.gr", "e-iatreio.gr", "doctorsnet.gr",
    "medicalnet.gr", "zocdoc.com", "docplanner.com",
)
#: Signs of a blocked fetch, fixed values.
BLOCK_STATUS = (403, 429, 503)
BLOCK_TITLES = ("Just a moment...", "Attention Required", "Access Denied", "Checking your browser")
BLOCK_BODIES = ('"cType":"managed"', '"cType":"interactive"', '"cType":"non-interactive"', "challenges.cloudflare.com/turnstile")

#: What counts as a host name, a fixed value: labels of 63 characters, 253 in all, at least two.
HOSTNAME = r"^(?=.{1,253}$)(?!-)[a-z0-9-]{1,63}(?<!-)(\.(?!-)[a-z0-9-]{1,63}(?<!-))+$"


def authority(url: Column) -> Column:
    """Lower-cased host with port and user, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def hostname(url: Column) -> Column:
    """Lower-cased host of a URL or of a bare www.x.gr; null for what is no host name."""
    bare = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host.rlike(HOSTNAME), host)


def under(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one."""
    return host.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def website_kind(url: Column) -> Column:
    host = hostname(url)
    return (
        F.when(host.isNull(), "none")
        .when(under(host, DIRECTORIES), "directory")
        .when(under(host, SOCIAL), "social")
        .when(under(host, BOOKING), "booking")
        .otherwise("own")
    )


def lacks_website(kind: Column, social_counts: bool = True, booking_counts: bool = True) -> Column:
    none = ["none", "directory"] + ["social"] * social_counts + ["booking"] * booking_counts
    return kind.isin(none)


def canonical(url: Column) -> Column:
    """The URL for deduplication: http for https, lower-cased host, no fragment, no trailing slash."""
    plain = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, r"^[^?]*(\?.+)$", 1)
    return F.concat(
        F.when(scheme == "https", "http").otherwise(scheme), F.lit("://"), authority(url), F.when(path == "", "/").otherwise(path), query
    )


def matches_pattern(host: Column, pattern: str) -> Column:
    """*.x is x and all below it; other wildcards are globs; else the host itself."""
    pattern = pattern.lower()
    if pattern.startswith("*."):
        return under(host, (pattern[2:],))
    if any(c in pattern for c in "*?["):
        parts = {"*": ".*", "?": ".", ".": r"\."}
        return host.rlike("^" + "".join(parts.get(c, c) for c in pattern) + "$")
    return host == pattern


def allowed(url: Column, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """deny, not_listed or allowed; denial comes first."""
    host = F.coalesce(hostname(url), F.lit(""))
    any_of = lambda patterns: F.array_contains(F.array(*[matches_pattern(host, p) for p in patterns]), True)
    out = F.when(any_of(deny), "deny") if deny else F.when(F.lit(False), "deny")
    return out.when(~any_of(allow), "not_listed").otherwise("allowed") if allow else out.otherwise("allowed")


def block_reason(status: Column, title: Column, body: Column) -> Column:
    """Why a fetch counts as blocked, else null."""
    has = lambda text, marks: F.array_contains(F.array(*[F.contains(text, F.lit(m)) for m in marks]), True)
    return (
        F.when(status.isin(*BLOCK_STATUS), F.concat(F.lit("status "), status))
        .when(has(title, BLOCK_TITLES), "challenge title")
        .when(has(body, BLOCK_BODIES), "challenge body")
    )


def root_job(job_id: Column) -> Column:
    stripped = F.regexp_replace(job_id, "^(rec_)+", "")
    return F.when(stripped == "", job_id).otherwise(stripped)
