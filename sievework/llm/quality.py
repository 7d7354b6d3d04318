"""Quality rules with thresholds taken from the corpus.

Each measure of a document is compared with fences of its own language and
source. The fences come from relative-error quantile sketches: counts of
logarithmic bins, which merge by addition, so that they are combined before
the shuffle, no group is gathered, and a rerun gives the same thresholds.
Sketches of sources merge into those of languages and of the whole corpus,
towards which the quantiles of a group are drawn, the more the smaller it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_batches, small_side

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8
#: Base rules: fewest words, and the largest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Relative error of the quantile sketches.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Documents' worth of its language that a group's quantiles are mixed with,
#: and of the whole corpus that a language's are.
PRIOR = 100
#: Distance of the fences from the median, in widths of the quarter below it,
#: all on the logarithmic scale. The half above is not asked: up to half of a
#: group may be junk. A width is one bin at least, the sketch's own error.
REACH = 6.0
#: Measures that are also too low below a fence.
TWO_SIDED = {"word_length"}

MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in `width`-word windows that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    step[at] += 1
    np.subtract.at(step, at + width, 1)
    return int((np.cumsum(step) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The values of MEASURED for one text; all zero for null."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, SPACES).decode(errors="replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(lines), repeated_words(words)


def measured(text: Column) -> Column:
    @F.pandas_udf(MEASURED)
    def measures(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEASURED.split(", ")]
        for part in parts:
            yield pd.DataFrame(np.array([measure(x) for x in part], np.int64).reshape(-1, len(names)), columns=names)

    # not moved or repeated by the optimizer: a filter on the verdict must not measure anew
    return measures.asNondeterministic()(text.cast("binary"))


#: Measure: what is counted, per what, and what is added to both. One is added
#: to counts that are mostly zero, so that a document without any has a value
#: too: less, the longer it is.
RATIOS = {"symbol_share": ("n_symbols", "word_chars", 1), "repeat_share": ("n_repeat_words", "n_words", 1), "word_length": ("word_chars", "n_words", 0)}


def shares(m: str) -> dict[str, Column]:
    """The measures that have fences, from the struct column m; null where nothing was counted."""
    return {k: F.try_divide(F.col(f"{m}.{a}") + more, F.col(f"{m}.{b}") + more).cast("double") for k, (a, b, more) in RATIOS.items()}


def base_failed(m: str) -> Column:
    n = F.col(f"{m}.n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED * n)


def fences(measures: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) for every lang and source
    with a document that passes the base rules.

    measures: lang, source and a struct column m. Documents that fail the base
    rules count for no quantile; null lang and source are groups like any
    other. One row a group, however many documents it has.
    """
    values = shares("m")
    pairs = ", ".join(f"'{k}', {k}" for k in values)
    nothing = F.lit(None).cast("string")
    levels = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), nothing), (2, nothing, nothing)]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in levels]))
    sketches = (
        measures.where(~base_failed("m"))
        .select("lang", "source", *[v.alias(k) for k, v in values.items()])
        .select("lang", "source", F.expr(f"stack({len(values)}, {pairs}) as (measure, value)"))
        .withColumn("bin", F.ceil(F.log("value") / F.lit(math.log(GAMMA))))
        .groupBy("lang", "source", "measure", "bin")
        .agg(F.count("*").alias("n"))
        # merged to languages and to the whole: at most some thousand bins a sketch
        .select(at.alias("at"), "measure", "bin", "n")
        .groupBy("at", "measure", "bin")
        .agg(F.sum("n").alias("n"))
    )
    sketch = Window.partitionBy("at", "measure")
    reached = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * share), F.col("bin"))).cast("double")
    quartiles = (
        sketches.withColumn("upto", F.sum("n").over(sketch.orderBy("bin")))
        .withColumn("total", F.sum("n").over(sketch))
        .groupBy("at", "measure")
        .agg(F.max("total").alias("n"), reached(0.25).alias("q1"), reached(0.5).alias("q2"))
    )
    quartiles = saved(quartiles.select("at.*", "measure", "n", "q1", "q2"))  # three levels read it
    of = lambda level, name: quartiles.where(F.col("level") == level).select(
        F.col("lang").alias(f"{name}_lang"), F.col("measure").alias(f"{name}_measure"), F.struct("n", "q1", "q2").alias(name)
    )
    drawn = lambda own, n, other: (own * n + other * PRIOR) / (n + F.lit(PRIOR))
    joined = (
        quartiles.where("level = 0")
        .join(of(1, "tongue"), F.col("lang").eqNullSafe(F.col("tongue_lang")) & (F.col("measure") == F.col("tongue_measure")))
        .join(of(2, "every"), F.col("measure") == F.col("every_measure"))
    )
    for q in ("q1", "q2"):
        parent = drawn(F.col(f"tongue.{q}"), F.col("tongue.n"), F.col(f"every.{q}"))
        joined = joined.withColumn(f"drawn_{q}", drawn(F.col(q), F.col("n"), parent))
    reach = REACH * F.greatest(F.col("drawn_q2") - F.col("drawn_q1"), F.lit(1.0))
    value = lambda at: F.pow(F.lit(GAMMA), at) * (2 / (GAMMA + 1))
    out = []
    for k in values:
        high, low = value(F.col("drawn_q2") + reach), value(F.col("drawn_q2") - reach) if k in TWO_SIDED else F.lit(0.0)
        out += [F.max(F.when(F.col("measure") == k, v)).alias(f"{k}_{side}") for side, v in (("low", low), ("high", high))]
    return joined.groupBy("lang", "source").agg(*out)


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """measures with base_failed and kept; limits: as fences() gives them."""
    limits = small_side(saved(limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})))
    joined = measures.join(
        limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    inside = F.lit(True)
    for k, v in shares("m").items():
        inside &= F.coalesce(v.between(F.col(f"{k}_low"), F.col(f"{k}_high")), F.lit(True))
    failed = base_failed("m")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and n_lines, one row a document.

    A null text has no words and fails. A value that equals its fence is
    inside. Repeated rows each give a row and each count. An empty table gives
    an empty table. Columns besides doc_id, text, lang and source are ignored.
    Texts are measured whole; the time is in proportion to their length.
    """
    small_batches(docs.sparkSession)
    measures = saved(docs.select("doc_id", "lang", "source", "text").select("doc_id", "lang", "source", measured(F.col("text")).alias("m")))
    own = [f"m.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(measures, fences(measures)).select("doc_id", *own, "base_failed", "kept", "m.n_lines")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without those that fail; columns and their order stay.

    Null, empty and wordless texts fail; an empty table stays empty. Other
    columns may have any name.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = lambda x: inner[names.index(x)]
    plain = docs.toDF(*inner)
    measures = plain.select(
        *inner, F.col(at("lang")).alias("lang"), F.col(at("source")).alias("source"), measured(F.col(at("text"))).alias("m")
    )
    return judged(measures, fences(measures.select("lang", "source", "m"))).where("kept").select(*inner).toDF(*names)
