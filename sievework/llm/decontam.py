"""Benchmark decontamination: SimHash of item-sized windows, Hamming
neighbours by a multi-index, exact weighted-shingle similarity."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import bit_counts
from .common import ALNUM, small_batches

#: Words of a shingle, and the similarity from which a window is a copy.
WIDTH, SIMILAR = 5, 0.8
#: Bits in which a window's fingerprint may differ from its item's. Two
#: multisets of similarity 0.8 differ in 9 of 64 bits on average, give or take 3.
RADIUS = 19
#: The multi-index: fingerprints within the radius have a block of 16 bits
#: that differs in RADIUS // BLOCKS bits at most.
BLOCKS, BLOCK_BITS = 4, 16
#: Items and bytes of text of one broadcast index; more are searched in several passes.
BATCH_ITEMS, BATCH_BYTES = 20_000, 16 << 20
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 20
SLOTS = 1 << 20


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, from the words' hashes."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Of the words of a text: runs of letters and digits, A-Z lower-cased."""
    words = (text or b"").translate(ALNUM).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def simhash(hashes: np.ndarray) -> int:
    on = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


@dataclass
class Item:
    item_id: object
    length: int
    values: np.ndarray
    counts: np.ndarray
    fingerprint: int


@dataclass
class Index:
    """One batch of items: their shingles by window length, and their
    fingerprints in BLOCKS tables by block value."""

    items: list[Item]
    #: shingle width: (slots that any shingle falls in, sorted shingles)
    gates: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: window length: its items' sorted shingles
    by_length: dict[int, np.ndarray] = field(default_factory=dict)
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    masks: np.ndarray | None = None

    def near(self, fingerprint: int, length: int) -> list[Item]:
        """The items of this length within the radius of the fingerprint."""
        found: set[int] = set()
        for b, (starts, numbers) in enumerate(self.tables):
            keys = self.masks ^ ((fingerprint >> (b * BLOCK_BITS)) & 0xFFFF)
            full = keys[starts[keys + 1] > starts[keys]]
            for k in full.tolist():
                found.update(numbers[starts[k] : starts[k + 1]].tolist())
        items = (self.items[i] for i in sorted(found))
        return [x for x in items if x.length == length and (x.fingerprint ^ fingerprint).bit_count() <= RADIUS]


def build_index(rows: list[tuple[object, bytes | None]]) -> Index:
    """The index of (item_id, text); items without words are left out."""
    known = WordHashes()
    items: list[Item] = []
    for item_id, text in rows:
        words = word_hashes(text, known)
        if len(words):
            h = shingles(words, min(WIDTH, len(words)))
            items.append(Item(item_id, len(words), *np.unique(h, return_counts=True), simhash(h)))
    index = Index(items)
    for width in {min(WIDTH, x.length) for x in items}:
        values = np.unique(np.concatenate([x.values for x in items if min(WIDTH, x.length) == width]))
        slots = np.zeros(SLOTS, bool)
        slots[values >> np.uint64(44)] = True
        index.gates[width] = slots, values
    for length in {x.length for x in items}:
        index.by_length[length] = np.unique(np.concatenate([x.values for x in items if x.length == length]))
    fps = np.array([x.fingerprint for x in items], np.uint64)
    for b in range(BLOCKS):
        keys = ((fps >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
        starts = np.r_[0, np.cumsum(np.bincount(keys, minlength=1 << BLOCK_BITS))]
        index.tables.append((starts, np.argsort(keys, kind="stable")))
    bits = range(BLOCK_BITS)
    index.masks = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(bits, k)])
    return index


def similarity(window: np.ndarray, item: Item) -> float:
    """Weighted Jaccard similarity of the shingle multisets."""
    values, counts = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(item.values, values), len(item.values) - 1)
    shared = int(np.minimum(counts, item.counts[at])[item.values[at] == values].sum())
    return shared / (len(window) + int(item.counts.sum()) - shared)


def find(text: bytes | None, index: Index, known: WordHashes) -> list[tuple[object, int, int, int, float]]:
    """(item_id, first_word, n_words, n_windows, similarity) of each item of
    which the text has a copy; the place is that of the best window, the first
    of equals. A text shorter than an item is one window.

    A window can reach the similarity only if at least 2s / (1 + s) of its
    shingles are among those of items of its length, so that only such windows
    are fingerprinted: nothing that could match is passed over.
    """
    words = word_hashes(text, known)
    best: dict[int, tuple] = {}

    def compare(window: np.ndarray, i: int, length: int, n_words: int) -> None:
        for item in index.near(simhash(window), length):
            s = similarity(window, item)
            if s >= SIMILAR - 1e-12:
                was = best.get(id(item))
                n = (was[3] if was else 0) + 1
                new = (item.item_id, i, n_words, n, s)
                best[id(item)] = new if not was or s > was[4] else (*was[:3], n, was[4])

    for width, (slots, values) in index.gates.items():
        h = shingles(words, width)
        hits = np.flatnonzero(slots[h >> np.uint64(44)])
        if len(hits):
            at = np.minimum(np.searchsorted(values, h[hits]), len(values) - 1)
            hits = hits[values[at] == h[hits]]
        if not len(hits):
            continue
        for length, own in index.by_length.items():
            m = length - width + 1
            if min(WIDTH, length) != width:
                continue
            if m > len(h):
                shared = np.isin(h[hits], own).sum()
                if len(h) >= SIMILAR * m - 1e-9 and shared >= SIMILAR / (1 + SIMILAR) * (m + len(h)) - 1e-9:
                    compare(h, 0, length, len(words))
                continue
            marks = np.zeros(len(h) + 1, np.int64)
            marks[hits[np.isin(h[hits], own)] + 1] = 1
            upto = np.cumsum(marks)
            for i in np.flatnonzero(upto[m:] - upto[:-m] >= 2 * SIMILAR / (1 + SIMILAR) * m - 1e-9).tolist():
                compare(h[i : i + m], i, length, length)
    return list(best.values())


def batches(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded batches of the items, as many as it takes."""
    size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-size[0] // BATCH_ITEMS), -(-size[1] // BATCH_BYTES))
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), n) == k)
        yield build_index([(r[0], None if r[1] is None else bytes(r[1])) for r in part.select("item_id", F.col("text").cast("binary")).collect()])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_windows, similarity: a row for
    each document and benchmark item that it has a copy of.

    Null or wordless texts hold nothing, null or wordless items are in
    nothing. An item below five words is one shingle. Repeated documents and
    items each give rows. Other columns are ignored; empty tables give none.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out = None
    for index in batches(benchmark.select("item_id", "text")):
        shared = sc.broadcast(index)  # BATCH_ITEMS and BATCH_BYTES bound it

        def search(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for part in parts:
                rows = [
                    (doc_id, *found)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for found in find(text, shared.value, known)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                names = ["doc_id", "item_id", "first_word", "n_words", "n_windows", "similarity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        schema = "doc_id long, item_id long, first_word long, n_words long, n_windows long, similarity double"
        texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        found = texts.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return out


def holds_any(text: Column, index: object) -> Column:
    """Whether a text holds a copy of any item of the broadcast index."""

    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordHashes()
        for part in parts:
            yield pd.Series([bool(find(x, index.value, known)) for x in part], dtype=bool)

    return holds(text.cast("binary"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a copy of a benchmark item; columns and
    their order stay, rows are not moved. Null and empty texts hold none; an
    empty table, or an empty benchmark, leaves all as it is."""
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    kept = docs.toDF(*inner)
    for index in batches(benchmark.select("item_id", "text")):
        kept = kept.where(~holds_any(F.col(inner[names.index("text")]), docs.sparkSession.sparkContext.broadcast(index)))
    return kept.toDF(*names)
