"""SimHash near-duplicate groups of documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitslice import group_numbers, hamming_links, majority, whole_groups
from .common import saved, small_batches
from .components import connected_components

SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the lower-cased `width`-word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The text's fingerprint as a signed 64-bit integer; zero without words."""
    hashes = shingle_hashes(text or b"", width)
    if not len(hashes):
        return 0
    fp = majority(hashes)
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprint_column(text: Column, width: int = 4) -> Column:
    @F.pandas_udf("long")
    def fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint(x, width) for x in part], dtype="int64")

    return fingerprints(text.cast("binary"))


def near_groups(signed: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id): for each distinct fp of (doc_id, fp) the smallest
    doc_id among all fingerprints reachable in steps of `radius` bits or fewer."""
    roots = connected_components(hamming_links(signed.select("fp"), radius), "a", "b")
    firsts = signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("low_id"))
    named = linked.join(lowest, "root").select("fp", "low_id")
    return firsts.join(named, "fp", "left").select("fp", F.coalesce("low_id", "first_id").alias("component_id"))


def simhash_groups(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row a document.

    Texts without words, null ones among them, have fingerprint zero and are
    linked like any other. Repeated rows each give a row. A null doc_id is
    never a component's id unless all its members' are null. Other columns
    are ignored. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    signed = saved(docs.select("doc_id", fingerprint_column(F.col("text"), width).alias("fp")))
    return signed.join(near_groups(signed, radius), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Near copies of the pipeline: five-word shingles, bits in which the fingerprints
#: of close ones differ at most, similarity, texts compared in one place.
WIDTH, RADIUS, SIMILAR, CHUNK = 5, 4, 0.8, 256
#: Shingles whose hash falls in so many of eight classes are counted over all texts.
SAMPLED = 3
#: Classes of the shingle counts that a pair is weighed by before its shingles are compared.
CLASSES = 128


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets is SIMILAR or more."""
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if not most:
        return True
    if least < SIMILAR * most:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= SIMILAR * (len(a) + len(b) - shared) - 1e-9


def distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def own_shingles(text: bytes | None) -> np.ndarray:
    """The text's distinct shingles; texts without words share one that stands for none."""
    return distinct(shingle_hashes(text or b"", WIDTH))


def shingle_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, n, m, fp, own) from (doc_id, mark, text): the number of the text's
    shingles, and of those in the sampled classes, the text's fingerprint, and
    the hash of its set of shingles."""
    for batch in batches:
        n, m, fps, sets = [], [], [], []
        for text in batch.column("text").to_pylist():
            every = shingle_hashes(text or b"", WIDTH)
            own = distinct(every)
            n.append(len(own))
            m.append(int((own & np.uint64(7) < SAMPLED).sum()))
            fps.append(majority(every) if len(every) else 0)
            sets.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
        fp, of_set = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sets))
        columns = [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int32()), pa.array(m, pa.int32()), fp, of_set]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "m", "fp", "own"])


def exploded(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """(mark, h) from (mark, text): the shingles in so many of eight classes."""
    for batch in batches:
        every = [own_shingles(x) for x in batch.column("text").to_pylist()]
        every = [h[h & np.uint64(7) < classes] for h in every]
        marks = np.repeat(batch.column("mark").to_numpy(), [len(h) for h in every])
        hs = np.concatenate([*every, np.zeros(0, np.uint64)]).view(np.int64)
        for k in range(0, len(hs), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(marks[k : k + (1 << 20)]), pa.array(hs[k : k + (1 << 20)])], ["mark", "h"])


def sampled_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return exploded(batches, SAMPLED)


def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return exploded(batches, 8)


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(mark, h, df) of the shingles that df > 1 texts have, from (mark, h) sorted by h."""
    for batch in whole_groups(batches, ["h"]):
        h, mark = (batch.column(x).to_numpy() for x in ("h", "mark"))
        at = np.lexsort((mark, h))
        h, mark = h[at], mark[at]
        first = np.r_[True, (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])]  # equal texts count once
        h, mark = h[first], mark[first]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        df = np.repeat(sizes, sizes)
        yield mark[df > 1], h[df > 1], df[df > 1]


def shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, shared): how many of a text's shingles other texts have too, in parts to be added up."""
    for mark, _, _ in shared_rows(batches):
        marks, n = np.unique(mark, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(n)], ["mark", "shared"])


def shared_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for mark, h, df in shared_rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(h), pa.array(df)], ["mark", "h", "df"])


def possible_pairs(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Index pairs that can be similar: a pair of similarity 0.8 differs in a
    ninth of its shingles at most, and so do the counts of any classes."""
    sizes = np.array([len(x) for x in sets])
    counts = np.stack([np.bincount((x >> np.uint64(32)).astype(np.int64) % CLASSES, minlength=CLASSES) for x in sets]).astype(np.int32)
    for i in range(len(sets) - 1):
        apart = np.abs(counts[i + 1 :] - counts[i]).sum(axis=1)
        most = (1 - SIMILAR) / (1 + SIMILAR) * (sizes[i + 1 :] + sizes[i]) + 1e-6
        yield from ((i, j) for j in (i + 1 + np.flatnonzero(apart <= most)).tolist())


def near_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the marks of rows (g, lo, hi, mark, own, text) whose texts
    are similar, group by group. A pair that other links connect already is not
    compared; texts of the same `own` are connected from the beginning."""
    keys = ["g", "lo", "hi"]
    for batch in whole_groups(batches, keys, rows=2_000):
        numbers = group_numbers(batch, keys)
        starts = np.r_[np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]), len(numbers)]
        marks, owns, texts = batch.column("mark").to_pylist(), batch.column("own").to_pylist(), batch.column("text")
        a, b = [], []
        for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sets = [own_shingles(texts[i].as_py()) for i in range(first, last)]
            met: dict[int, int] = {}
            root = [met.setdefault(x, i) for i, x in enumerate(owns[first:last])]

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in possible_pairs(sets):
                if (x := top(i)) != (y := top(j)) and similar(sets[i], sets[j]):
                    root[max(x, y)] = min(x, y)
                    a.append(marks[first + i])
                    b.append(marks[first + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def by_shingle(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h")


def sharing(firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (mark, n, m, ...) of texts that can have a near copy.

    All but a fifth of such a text's shingles are in the copy, so that a text
    with more that no other text has is left out. Those of the sampled classes
    are counted, over all texts; that leaves out fewer, never more.
    """
    rows = texts.select("mark", "text").mapInArrow(sampled_shingles, "mark long, h long")
    shared = by_shingle(rows).mapInArrow(shared_counts, "mark long, shared long").groupBy("mark").agg(F.sum("shared").alias("shared"))
    alone = F.col("m") - F.coalesce("shared", F.lit(0))
    return firsts.join(shared, "mark", "left").where(alone <= F.floor(F.col("n") / 5)).drop("m", "shared")


def candidate_links(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): links that connect all texts of (mark, text) that can be similar;
    sizes: (mark, n).

    With the shingles of all texts in one order, the rarest first, texts of
    similarity 0.8 have one in common among the first fifth, and one more, of
    each: the prefix filter. Texts that share such a shingle are linked by the
    smallest of them. Shingles of one text alone stand before all others and
    link nothing, so that their number is enough.
    """
    rows = by_shingle(texts.mapInArrow(all_shingles, "mark long, h long")).mapInArrow(shared_shingles, "mark long, h long, df long")
    whole = Window.partitionBy("mark")
    placed = rows.select("mark", "h", F.row_number().over(whole.orderBy("df", "h")).alias("rank"), F.count("*").over(whole).alias("shared"))
    early = placed.join(sizes, "mark").where(F.col("n") - F.col("shared") + F.col("rank") <= F.floor(F.col("n") / 5) + 1)
    early = saved(early.select("h", "mark"))
    return early.join(early.groupBy("h").agg(F.min("mark").alias("low")), "h").select(F.col("mark").alias("a"), F.col("low").alias("b"))


def lowest_of(texts: DataFrame, column: str) -> DataFrame:
    """(column, low): the smallest mark of the texts of (mark, column) that share a value."""
    return texts.groupBy(column).agg(F.min("mark").alias("low"))


def to_lowest(texts: DataFrame, lowest: DataFrame, column: str) -> DataFrame:
    """(a, b): a link from each text to the lowest of its value; none from that itself."""
    return texts.join(lowest, column).where(F.col("mark") != F.col("low")).select(F.col("mark").alias("a"), F.col("low").alias("b"))


def close_links(texts: DataFrame) -> DataFrame:
    """(a, b): links that connect the texts of (mark, fp) whose fingerprints are
    connected in steps of RADIUS bits; the smallest mark stands for a fingerprint."""
    lowest = saved(lowest_of(texts, "fp"))
    of = lambda end: lowest.select(F.col("fp").alias(end), F.col("low").alias(f"low_{end}"))
    links = hamming_links(lowest.select("fp"), RADIUS).distinct().join(of("a"), "a").join(of("b"), "b")
    return to_lowest(texts, lowest, "fp").unionAll(links.select("low_a", "low_b"))


def keep_first_of_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: the one of the smallest
    (doc_id, text hash), null doc_ids last. Columns and their order stay; rows
    equal in doc_id and text count as one document.

    Texts are linked if they are equal, or if the similarity of their five-word
    shingles is SIMILAR or more; no such pair is passed over. Texts without
    words, null ones among them, are one group. Candidates are texts whose
    fingerprints are linked in steps of RADIUS bits, the close copies, and what
    the prefix filter links, which is all that can be similar. Their groups
    together are compared; texts of the same set of shingles are connected
    without that. Texts of candidates alone are compared, in chunks of CHUNK;
    to find them all texts are joined with them.
    """
    small_batches(docs.sparkSession)
    mark = F.xxhash64("text")
    texts = docs.select("doc_id", mark.alias("mark"), F.col("text").cast("binary").alias("text"))
    signed = texts.mapInArrow(shingle_numbers, "doc_id long, mark long, n int, m int, fp long, own long")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    of_mark = [F.first(c).alias(c) for c in ("n", "m", "fp", "own")]  # equal texts have the same
    firsts = saved(signed.withColumn("order", order).groupBy("mark").agg(F.min("order").alias("first"), *of_mark))

    def with_text(wanted: DataFrame) -> DataFrame:
        """The text of each row's first document."""
        wanted = wanted.withColumn("of_id", F.col("first.doc_id")).withColumnRenamed("mark", "of_mark").drop("first")
        found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
        return found.drop("doc_id", "of_id", "of_mark")

    def compared(candidates: DataFrame) -> DataFrame:
        """Links (a, b) between similar texts of (mark, first, g, own), group by
        group; groups whose texts are all of one `own` are connected."""
        open_ones = candidates.groupBy("g").agg(F.count("*").alias("k"), F.min("own").alias("low"), F.max("own").alias("high")).where("low < high")
        dealt = (
            with_text(candidates.join(open_ones.select("g", F.ceil(F.col("k") / CHUNK).cast("int").alias("chunks")), "g"))
            .withColumn("c", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("g", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"), "mark", "own", "text")
        )
        by = ["g", "lo", "hi"]
        return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(near_copies, "a long, b long")

    able = saved(sharing(firsts, texts))
    links = candidate_links(with_text(able.select("mark", "first")).select("mark", "text"), able.select("mark", "n"))
    groups = connected_components(links.unionAll(close_links(able.select("mark", "fp"))), "a", "b")
    rest = saved(able.join(groups.select(F.col("node").alias("mark"), F.col("root").alias("g")), "mark").select("mark", "first", "g", "own"))
    links = compared(rest).unionAll(to_lowest(rest, lowest_of(rest, "own"), "own"))
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "mark")
    linked = firsts.join(roots, "mark").select("root", "mark", "first")
    heads = linked.groupBy("root").agg(F.min("first").alias("first"))
    # a text's own first row stays, unless its group has an earlier one
    lost = linked.join(heads.withColumnRenamed("first", "head"), "root").where(F.col("first") != F.col("head")).select("mark")
    winners = firsts.join(lost, "mark", "left_anti").select(F.col("first.doc_id").alias("won_id"), F.col("mark").alias("won_mark"))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # no column of docs can clash with the helpers
    plain = docs.toDF(*inner)
    doc_id, text = (plain[inner[names.index(x)]] for x in ("doc_id", "text"))
    kept = plain.withColumn("own_mark", F.xxhash64(text)).join(
        winners, doc_id.eqNullSafe(F.col("won_id")) & (F.col("own_mark") == F.col("won_mark")), "left_semi"
    )
    return kept.dropDuplicates([inner[names.index("doc_id")], "own_mark"]).select(*inner).toDF(*names)
