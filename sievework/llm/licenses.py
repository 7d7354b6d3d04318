"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence
expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, small_batches

#: Notice phrases of the base scan and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases that the method adds.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
#: The tag before a licence expression, in words.
TAG = "spdx license identifier"
#: Identifier prefixes of licence expressions and their labels.
IDENTIFIERS = {
    "AGPL": "agpl", "LGPL": "lgpl", "GPL": "gpl", "Apache": "apache", "MIT": "mit", "BSD": "bsd", "ISC": "isc",
    "MPL": "mpl", "EPL": "epl", "BSL": "bsl", "CC-BY": "cc-by", "CC0": "cc0", "Unlicense": "unlicense", "Zlib": "zlib",
}
#: How freely text under a label may be reused, from 0 to 1.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "proprietary": 0.0,
}
UNKNOWN = 0.1
#: An exception to a copyleft licence makes it as free as this at least.
EXCEPTED = 0.6

PRIORITY = {"OR": 1, "AND": 2, "WITH": 3}
_TAGGED = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9 .+()-]+)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")

SCANNED = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def to_postfix(expression: str) -> list[str]:
    """The tokens in postfix order (shunting-yard); ValueError if malformed.

    A word where an operator should stand ends the expression: a tag's line
    may go on in prose. So operators are upper-case only, and one before
    a lower-case word that is no licence ends it too.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True  # what must come next
    tokens = _TOKEN.findall(expression)
    for token, after in zip(tokens, [*tokens[1:], ""], strict=True):
        if token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in PRIORITY:
            if operand:
                raise ValueError(f"operator without operand: {expression!r}")
            if after.islower() and label_of(after) is None:
                break  # prose
            while held and held[-1] != "(" and PRIORITY[held[-1]] >= PRIORITY[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
    if operand or "(" in held:
        raise ValueError(f"incomplete expression: {expression!r}")
    return out + held[::-1]


def label_of(identifier: str) -> str | None:
    low = identifier.lower().rstrip(".")
    return next((v for k, v in IDENTIFIERS.items() if low == k.lower() or low.startswith(f"{k.lower()}-")), None)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels of the licences named, and how freely the whole may be used: the
    least of both sides of AND, the most of OR; WITH lifts its licence."""
    stack: list[tuple[set[str], float]] = []
    for token in to_postfix(expression):
        if token not in PRIORITY:
            label = label_of(token)
            stack.append(({label} if label else set(), FREEDOM.get(label, UNKNOWN)))
            continue
        (right, free), (left, freer) = stack.pop(), stack.pop()
        if token == "WITH":
            stack.append((left, max(freer, EXCEPTED)))
        else:
            stack.append((left | right, min(free, freer) if token == "AND" else max(free, freer)))
    return stack[0]


def phrase_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for base, phrases in ((True, BASE), (False, MORE), (False, {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (base, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple:
    """The values of SCANNED for one text."""
    text = text or b""
    words = text.translate(ALNUM).split()
    line = f" {b' '.join(words).decode(errors='replace')} "
    places, base, more, score, tagged = [], set(), set(), None, False
    for end, (is_base, label, size) in automaton.iter(line):
        if is_base:
            places.append(end - size + 1)  # of the blank before the first word
            base.add(label)
        elif label:
            more.add(label)
        else:
            tagged = True
    starts = []
    if places:
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        starts = np.searchsorted(blanks, places).tolist()
    freedoms = [FREEDOM[x] for x in base | more]
    if tagged:
        for expression in _TAGGED.findall(text.decode(errors="replace")):
            try:
                named, free = evaluate(expression)
            except ValueError:
                continue
            more |= named
            freedoms.append(free)
    score = min(freedoms) if freedoms else 0.0
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | more)), score,
    )


def scanned(text: Column) -> Column:
    @F.pandas_udf(SCANNED)
    def scans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = phrase_automaton()
        names = [x.split()[0] for x in SCANNED.split(", ")]
        for part in parts:
            out = pd.DataFrame([scan(x, automaton) for x in part], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scans(text.cast("binary"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCANNED, one row a document.

    Null texts are empty: no words, no places, empty labels, score zero.
    Repeated rows each give a row; other columns are ignored; an empty table
    gives an empty table. A malformed expression adds nothing. Texts are
    scanned whole, in time in proportion to their length.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", scanned(F.col("text")).alias("s")).select("doc_id", "s.*")
