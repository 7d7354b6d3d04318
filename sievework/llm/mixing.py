"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; a
source gives its documents in the order of their keys until its budget of
words is reached. Where the budget is more than the source has, whole epochs
come first and the order decides the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_side
from .sharding import prefix_sums

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, in percent, and the most epochs of a source.
SHARE, EPOCHS = 150, 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the fewer symbols a text has, the more it weighs; null texts weigh least."""
    plain = F.length(F.translate(text, SYMBOLS, ""))
    clean = 1 - 10 * (F.length(text) - plain) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(clean, F.lit(0.05)), F.lit(0.05))


def draw_key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> tuple[Column, Column]:
    """The exponential key and the digest it is drawn from: a pure function of
    the document, so that reruns and lost executors change nothing."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight, digest


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The targets are shares of the mix by weight, none above `epochs` times its
    source; what is cut is shared anew by weight until none is above. That is
    the level L at which the sum of min(epochs * size, L * weight) is the mix:
    sources in the order of the level that fills them are full up to some
    place, and L is the rest of the mix over the rest of the weights.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("long")
    limit = F.col("source_size") * epochs
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    later = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("mix") - F.coalesce(F.sum("limit").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    leveled = (
        totals.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("mix", F.sum("source_size").over(everything) * share / F.lit(100))
        .withColumn("fills_at", F.col("limit") / F.col("weight"))
        .withColumn("level", level)
        # the first place whose own level does not fill it; levels only fall from there on
        .withColumn("found", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("found") * F.col("weight"), F.col("limit").cast("double")))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def drawn(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, draw and digest: what the mix needs of a document."""
    weight = quality_weight(F.col("text"))
    draw, digest = draw_key(F.col("doc_id"), F.col("text"), weight, seed)
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), digest.alias("digest"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, draw and
    digest, one row a document.

    copies is how often the mix takes the document whole: the complete epochs
    of its source, and one more if its middle word lies within what is left of
    the budget, in the order of the draws. taken is copies times size. Null
    sources are a source of their own, the last; null texts have no words.
    Repeated rows are documents of their own. Other columns are ignored. An
    empty table gives an empty table.
    """
    keys = saved(drawn(docs, seed))
    totals = targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")))
    totals = totals.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(EPOCHS))).otherwise(0).cast("int"))
    totals = saved(totals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    placed = prefix_sums(keys, ["source", "draw", "digest"], "size").drop("total", "n_rows", "number")
    starts = placed.groupBy("source").agg(F.min("before").alias("start"))
    per_source = totals.join(starts, totals.source.eqNullSafe(starts.source)).drop(starts.source).withColumnRenamed("source", "of_source")
    per_source = small_side(saved(per_source))
    middle = F.col("before") - F.col("start") + F.col("size") / 2
    copies = F.col("epochs") + F.when((F.col("epochs") < EPOCHS) & (F.col("size") > 0) & (middle <= F.col("budget")), 1).otherwise(0)
    return (
        placed.join(per_source, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("copies", copies)
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), "draw", "digest", "epochs",
        )
    )


def mixture(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken; columns and
    their order stay.

    Whether a row is taken once more follows from its own draw and the last
    draw that its source takes, so that no text is shuffled. Rows equal in
    doc_id, text and source share their draw and are taken alike. Null and
    wordless texts are not taken; an empty table stays empty.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = lambda x: F.col(inner[names.index(x)])
    plain = docs.toDF(*inner)
    mix = mixed(docs, seed)
    last = F.max(F.when(F.col("copies") > F.col("epochs"), F.struct("draw", "digest"))).alias("last")
    cuts = saved(mix.groupBy(F.col("source").alias("of_source"), "epochs").agg(last))
    draw, digest = draw_key(at("doc_id"), at("text"), quality_weight(at("text")), seed)
    once_more = F.when((word_count(at("text")) > 0) & (F.struct(draw.alias("draw"), digest.alias("digest")) <= F.col("last")), 1).otherwise(0)
    return (
        plain.join(small_side(cuts), at("source").eqNullSafe(F.col("of_source")))
        .withColumn("copies", F.col("epochs") + once_more)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*inner)
        .toDF(*names)
    )
