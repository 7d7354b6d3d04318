"""Secret scans: base patterns, and a learned format grammar over all other
tokens.

Two scans of the texts: the first gathers labelled credentials and the
character pairs of all other tokens, the second finds the spans and scores
every token that no base span touches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, small_batches
from .grammar import ALPHABET, Automaton, codes_of, infer

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
#: What the grammar judges: every token of at least as many characters as a base value has.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Labelled strings the automata learn from, at most so many a format, the
#: smallest hashes of the distinct values of the whole corpus that are no longer than this.
SAMPLE, LONGEST = 1000, 256
#: One labelled string in so many is held out. A token must reach this part of
#: the mean log-likelihood ratio a character that all but a share of them reach:
#: credentials without a keyword stand among the ordinary tokens they are held against.
HELD_OUT, MISSED, PART = 5, 0.05, 0.5
#: And its ratio in all must make it this unlikely to be an ordinary token.
FALSE_ALARM = 1e-6
#: Tokens up to this length are scored together, a character at a time.
TOGETHER = 512

SPAN = "array<struct<kind:int,start:int,stop:int>>"


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, kind, end) of the base matches, by start, and the credentials in them."""
    out, values = [], []
    for m in ASSIGN.finditer(text) if ":" in text or "=" in text else ():
        if m.end(1) - m.start(1) >= 6:
            out.append((m.start(), 0, m.end()))
            values.append(m[1])
    for m in ACCESS.finditer(text) if "AKIA" in text else ():
        if m.end() - m.start() >= 20:
            out.append((m.start(), 1, m.end()))
            values.append(m[0])
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
        values.append(m[0])
    return sorted(out), values


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens that no base span touches; both lists are by
    start, so that they are gone through once."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            out.append((start, end))
    return out


def tokens_of(texts: list[str | None]) -> tuple[list, list, list, np.ndarray, np.ndarray]:
    """Of some texts: base spans, credentials and candidates of each, and the
    candidates' characters, one after the other, with their lengths."""
    spans, values, found, pieces = [], [], [], []
    for text in texts:
        text = text or ""
        base, own = base_spans(text)
        places = candidates(text, base)
        spans.append(base)
        values.append(own)
        found.append(places)
        pieces += [text[i:j] for i, j in places]
    return spans, values, found, codes_of("".join(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces))


def pairs_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each character with the one before it, in one number; a token's first comes after a blank."""
    before = np.r_[0, codes[:-1]] if len(codes) else codes
    before[np.cumsum(sizes) - sizes] = 0
    return before * ALPHABET + codes


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, pair, n) of (text): the credentials in base spans, and how often each
    pair of characters is in the other tokens."""
    for batch in slices(batches, "bytes"):
        _, values, _, codes, sizes = tokens_of(batch.column("text").to_pylist())
        n = np.bincount(pairs_of(codes, sizes), minlength=ALPHABET * ALPHABET)
        pair = np.flatnonzero(n)
        flat = list({v for own in values for v in own if len(v) <= LONGEST})
        columns = [
            pa.array(flat + [None] * len(pair), pa.string()), pa.array([None] * len(flat) + pair.tolist(), pa.int32()),
            pa.array([0] * len(flat) + n[pair].tolist(), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["v", "pair", "n"])


#: Occurrences that a character's own followers must outweigh: a rare one tells
#: little about what follows it.
PRIOR = 200


def background(counts: np.ndarray) -> np.ndarray:
    """log p(character | the one before) from the pair counts, drawn to the
    characters' own shares as far as the one before was seen little."""
    table = counts.reshape(ALPHABET, ALPHABET).astype(float)
    alone = (table.sum(0) + 0.5) / (table.sum() + 0.5 * ALPHABET)
    return np.log((table + PRIOR * alone) / (table.sum(1, keepdims=True) + PRIOR)).ravel()


@dataclass
class FormatModel:
    """Automata of credential formats and the mean ratio each asks for, against ordinary tokens."""

    formats: list[tuple[Automaton, float]]
    ordinary: np.ndarray

    def best(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each token is a secret in any of the formats."""
        out = np.zeros(len(sizes), bool)
        if not len(sizes):
            return out
        usual = np.add.reduceat(self.ordinary[pairs_of(codes, sizes)], np.cumsum(sizes) - sizes)
        for automaton, least in self.formats:
            ratio = automaton.log_likelihoods(codes, sizes, TOGETHER) - usual
            out |= (ratio / sizes >= least) & (ratio >= -np.log(FALSE_ALARM))
        return out

    def ratios(self, strings: list[str], automaton: Automaton) -> np.ndarray:
        codes, sizes = codes_of("".join(strings)), np.array([len(x) for x in strings])
        usual = np.add.reduceat(self.ordinary[pairs_of(codes, sizes)], np.cumsum(sizes) - sizes)
        return (automaton.log_likelihoods(codes, sizes, TOGETHER) - usual) / sizes


def smallest(values: DataFrame, n: int) -> list[str]:
    """At most n distinct values, those of the smallest hashes: a bounded sample
    that does not depend on the order of rows."""
    return [r.v for r in values.distinct().orderBy(F.xxhash64("v"), "v").limit(n).collect()]


def fit(docs: DataFrame, sample: int = SAMPLE) -> FormatModel:
    """The model learned from the labelled credentials of docs, a bounded
    sample, against the character pairs of all its other tokens."""
    texts = docs.select("text", F.col("text").cast("binary").alias("bytes"))
    found = saved(texts.mapInArrow(learned, "v string, pair int, n long"))
    counts = np.zeros(ALPHABET * ALPHABET, np.int64)
    for r in found.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # ALPHABET squared at most
        counts[r.pair] = r.n
    labelled = found.where("v is not null").select("v")
    kinds = (F.col("v").rlike("^[0-9a-f]+$"), F.col("v").startswith("AKIA"))
    groups = (kinds[0], ~kinds[0] & kinds[1], ~kinds[0] & ~kinds[1])
    model = FormatModel([], background(counts))
    for group in groups:
        strings = smallest(labelled.where(group), sample)
        if strings:
            taught = [s for i, s in enumerate(strings) if i % HELD_OUT]
            automaton = infer(taught or strings)
            reached = np.quantile(model.ratios(strings[::HELD_OUT], automaton), MISSED, method="lower")
            model.formats.append((automaton, PART * float(reached)))
    return model


def scanned(text: Column, model: FormatModel) -> Column:
    """Struct of base and added spans of a text."""

    @F.pandas_udf(f"base {SPAN}, added {SPAN}")
    def scans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        span = lambda k, s, e: {"kind": k, "start": s, "stop": e}
        for part in parts:
            base, added = [], []
            texts, first = part.tolist(), 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size < 1 << 20):
                    size += len(texts[last] or "")
                    last += 1
                spans, _, found, codes, sizes = tokens_of(texts[first:last])
                secret = iter(model.best(codes, sizes).tolist())
                base += [[span(k, s, e) for s, k, e in own] for own in spans]
                added += [[span(3, s, e) for s, e in own if next(secret)] for own in found]
                first = last
            yield pd.DataFrame({"base": pd.Series(base, dtype=object), "added": pd.Series(added, dtype=object)})

    return scans.asNondeterministic()(text)  # not computed once for each field


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["kind"].alias("k"), x["stop"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def secret_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, base, added): the base spans and those the grammar adds, one
    row a document, as arrays of (kind, start, stop) in code points.

    Null texts are empty and have no spans. Repeated rows each give a row;
    other columns are ignored. An empty table, or one without labelled
    credentials, adds no span. Texts and tokens are judged whole, in time in
    proportion to their length. Spans that start together stand as KINDS are listed.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, sample)
    return docs.select("doc_id", scanned(F.col("text"), model).alias("f")).select("doc_id", "f.*")


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from secret_spans()."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
    )
