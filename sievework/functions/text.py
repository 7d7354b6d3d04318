"""Text functions as Column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redactions of log text in their order: pattern, replacement. What is
#: redacted is fixed; the patterns are written so that a long word is gone
#: through once: a run starts where no run goes before, and is not given back.
LOG_RULES = (
    (r"(?i)(Bearer\s+)\S+", "$1[REDACTED]"),
    (r"(?i)(?<![a-z0-9+.\-])([0-9+.\-]*+[a-z][a-z0-9+.\-]*+://)[^/\s@]++@", "$1[dsn redacted]@"),
    (r"ss_[A-Za-z0-9_\-]{10,}", "ss_[REDACTED]"),
    (r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[email redacted]"),
    (r"(?i)\b(key|token|api[_-]?key)=[^&\s\"']+", "$1=[REDACTED]"),
)
#: Instructions hidden in scraped text, fixed values.
INJECTIONS = (
    r"(?i)ignore\s+previous\s+instructions?",
    r"(?i)(?<!\w)system\s*:",
    r"(?i)<\s*/?system\s*>",
    r"(?i)you\s+are\s+now\b",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)disregard\s+(all\s+)?previous",
)
#: Names of fields that hold personal data, fixed values.
PERSONAL_FIELDS = (
    "phone|telephone|mobile|cell|fax",
    "email|e-mail",
    "ssn|social.security|passport|national.id",
    "credit.card|cc.?num|card.number|pan|cvv|cvc",
    "password|secret|token|api.?key|auth.?key",
    "address|street|city|zip|postal.code|state|province",
    "birth|dob|date.of.birth",
    "bank.?account|routing|iban|swift|bic",
)
#: Characters that show nothing, and the form of a citation, fixed values.
HIDDEN = "[\\u200B-\\u200D\\uFEFF\\u2060\\u180E\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
CITATION = r"\[\[record:([^\]]+)\]\]"
#: Accented letters and their plain forms; what has no composed form is left.
ACCENTED = "άέήίόύώϊϋΐΰàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "αεηιουωιυιυaaaaaaceeeeiiiinooooouuuuyy"
PAYLOAD_BYTES = 512_000


def redacted_log(text: Column) -> Column:
    for pattern, new in LOG_RULES:
        text = F.regexp_replace(text, pattern, new)
    return text


def safe_prompt(text: Column) -> Column:
    """Text for a prompt: no null characters, no instructions."""
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, pattern, "[filtered]")
    return text


def without_hidden(text: Column) -> Column:
    return F.regexp_replace(text, HIDDEN, "")


def without_personal(data: Column) -> Column:
    """A flat map with the values of personal fields redacted."""
    personal = "(?i)" + "|".join(PERSONAL_FIELDS)
    return F.transform_values(data, lambda k, v: F.when(k.rlike(personal) & v.isNotNull(), "[REDACTED]").otherwise(v))


def _nested(data: Column, change) -> Column:
    """JSON text with a function of (key, value) applied to every value at any depth."""

    def walk(value, key=None):
        if isinstance(value, dict):
            return {k: walk(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, key) for v in value]
        return change(key, value)

    @F.pandas_udf("string")
    def changed(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if x is None else json.dumps(walk(json.loads(x)), ensure_ascii=False))

    return changed(data)


def without_personal_json(data: Column) -> Column:
    """JSON text with the values of personal fields redacted, at any depth; lists
    and objects under such a name are redacted value by value."""
    personal = re.compile("|".join(PERSONAL_FIELDS), re.IGNORECASE)
    return _nested(data, lambda key, value: "[REDACTED]" if key and value is not None and personal.search(key) else value)


def safe_prompt_json(data: Column) -> Column:
    """JSON text whose strings, at any depth, are fit for a prompt."""
    patterns = [re.compile(p) for p in INJECTIONS]

    def safe(key, value):
        if not isinstance(value, str):
            return value
        value = value.replace("\x00", "")
        for p in patterns:
            value = p.sub("[filtered]", value)
        return value

    return _nested(data, safe)


def fits_payload(text: Column, most: int = PAYLOAD_BYTES) -> Column:
    return F.octet_length(text) <= most


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ? before white space; none for blank text."""
    pieces = F.split(trimmed(text), r"(?<=[.!?])\s+")
    return F.filter(pieces, lambda s: trimmed(s) != "")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def cited_ids(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(CITATION), F.lit(1))


def citation_coverage(answer: Column) -> Column:
    """Share of the sentences that cite a record; one for an answer without sentences."""
    found = sentences(answer)
    cited = F.size(F.filter(found, lambda s: F.size(cited_ids(s)) > 0))
    return F.when(F.size(found) > 0, cited / F.size(found)).otherwise(1.0)


def only_supported(answer: Column, known: Column) -> Column:
    """The sentences that cite a known record, joined again."""
    kept = F.filter(sentences(answer), lambda s: F.arrays_overlap(cited_ids(s), known))
    return F.array_join(kept, " ")


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def content_hash(html: Column) -> Column:
    """Hash of a page without what changes from visit to visit."""
    html = F.regexp_replace(html, '(?i)name="csrf[_-]?token" value="[^"]*"', 'name="csrf_token" value=""')
    html = F.regexp_replace(html, r'data-timestamp="\d+"', 'data-timestamp=""')
    html = F.regexp_replace(html, 'id="__VIEWSTATE" value="[^"]*"', 'id="__VIEWSTATE" value=""')
    return F.sha2(html, 256)
