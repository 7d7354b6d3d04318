"""Hamming neighbours of 64-bit fingerprints by bit-sliced comparison.

``within_radius`` is the kernel: 64 pairs share a machine word, plane b of a
word holds the difference of all 64 pairs at bit b, and a carry-save adder
updates the 64 distances at once. A word whose pairs all exceed the radius is
abandoned.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side

BITS = 64
#: Buckets up to this size are compared together, shifted against themselves.
SMALL = 128
#: Words compared at a time in a larger bucket.
SLAB = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; bit 0 is the lowest."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    if len(bits) > 255:  # eight counters of a byte share a word: 255 rows at most before they widen
        bits = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        return bits.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return bits.sum(axis=0).view(np.uint8).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes, as an unsigned integer."""
    on = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes (64, words): bit j of word w of plane b is bit b of fingerprint 64w + j."""
    n = -(-len(fps) // BITS) * BITS
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(n, BITS)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder on planes: sum and carry."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within_radius(difference: Callable[[int, np.ndarray], np.ndarray], n_words: int, radius: int) -> np.ndarray:
    """For each word a mask of the pairs that differ in radius bits or fewer.

    difference(b, words): plane b of the difference at these words. Counters
    hold distances to 2**len(counters) - 1; what goes beyond is sticky.
    """
    width = max(3, (radius + 1).bit_length())
    out = np.zeros(n_words, np.uint64)
    words = np.arange(n_words)
    counters = [np.zeros(n_words, np.uint64) for _ in range(width)]
    over = np.zeros(n_words, np.uint64)
    for first in range(0, BITS, 8):
        carries = [difference(b, words) for b in range(first, first + 8)]
        for k in range(width):
            nxt = []
            for x, y in zip(carries[::2], carries[1::2], strict=False):
                counters[k], c = _add(counters[k], x, y)
                nxt.append(c)
            if len(carries) % 2:
                x = carries[-1]
                nxt.append(counters[k] & x)
                counters[k] = counters[k] ^ x
            carries = nxt
        for c in carries:
            over |= c
        # distance > radius, compared from the highest counter down
        beyond, equal = over.copy(), ~over
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                beyond |= equal & counters[k]
                equal &= ~counters[k]
        alive = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not alive.any():
            return out
        if first + 8 == BITS:
            out[words] = ~beyond
        elif alive.sum() < 0.75 * len(words):
            words, over = words[alive], over[alive]
            counters = [c[alive] for c in counters]
    return out


def _unpacked(masks: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(masks.view(np.uint8), bitorder="little")[:n].astype(bool)


def small_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) in the same bucket within the radius.

    Buckets stand one after the other, the largest first, SMALL rows at most
    each: shift s compares row i with row i + s, for the rows whose bucket is
    larger than s.
    """
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    planes = np.pad(planes_of(fps), ((0, 0), (0, 2)))
    found_i, found_j = [], []
    for s in range(1, int(sizes[0])):
        n = int(sizes[sizes > s].sum())
        q, r = divmod(s, BITS)
        lo, hi = np.uint64(r), np.uint64(BITS - r)

        def difference(b: int, words: np.ndarray, q=q, r=r, lo=lo, hi=hi) -> np.ndarray:
            plane = planes[b]
            moved = plane[words + q]
            if r:
                moved = (moved >> lo) | (plane[words + q + 1] << hi)
            return plane[words] ^ moved

        near = np.flatnonzero(_unpacked(within_radius(difference, -(-n // BITS), radius), n))
        near = near[near + s < len(fps)]
        near = near[bucket[near] == bucket[near + s]]
        found_i.append(near)
        found_j.append(near + s)
    return np.concatenate(found_i), np.concatenate(found_j)


def large_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one bucket within the radius: a slab of rows at
    a time against the planes of all rows."""
    n = len(fps)
    planes, words = planes_of(fps), -(-n // BITS)
    bits = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(n, BITS)
    asks = np.where(bits.T, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    found_i, found_j = [], []
    step = max(1, SLAB // words)
    for first in range(0, n, step):
        m = min(step, n - first)

        def difference(b: int, at: np.ndarray, first=first) -> np.ndarray:
            row, word = np.divmod(at, words)
            return asks[b][first + row] ^ planes[b][word]

        masks = within_radius(difference, m * words, radius)
        full = np.flatnonzero(masks)
        near = np.unpackbits(masks[full].view(np.uint8), bitorder="little").reshape(len(full), BITS)
        which, bit = np.nonzero(near)
        i, j = first + full[which] // words, full[which] % words * BITS + bit
        later = (i < j) & (j < n)
        found_i.append(i[later])
        found_j.append(j[later])
    return np.concatenate(found_i), np.concatenate(found_j)


def near_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs of one group within the radius."""
    if len(fps) <= 16:
        values = fps.tolist()
        yield from ((i, j) for j in range(len(fps)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= radius)
    else:
        i, j = large_pairs(fps, radius)
        yield from zip(i.tolist(), j.tolist(), strict=True)


def forest(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs that connect what was not connected before them."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
            yield a, b


def spanning_links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within the radius connect, group by group.

    groups: ascending group numbers, one a row. A group of m rows gives m - 1
    links at most.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    links: list[tuple[int, int]] = []
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    if len(small):
        small = small[np.argsort(-sizes[small], kind="stable")]
        lengths = sizes[small]
        rows = np.repeat(starts[small] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        links += [(rows[i], rows[j]) for i, j in forest(*small_pairs(fps[rows], lengths, radius))]
    for k in np.flatnonzero(sizes > SMALL):
        first = starts[k]
        links += [(first + i, first + j) for i, j in forest(*large_pairs(fps[first : first + sizes[k]], radius))]
    ends = np.array(links, int).reshape(-1, 2)
    return fps[ends[:, 0]], fps[ends[:, 1]]


def block_masks(n: int, kept: int) -> list[int]:
    """Masks of all choices of `kept` blocks out of n: two fingerprints within
    n - kept bits agree on at least one of them whole (pigeonhole)."""
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, kept)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> 63 else x


def hamming_links(fps: DataFrame, radius: int, kept: int = 2, chunk: int = 1024) -> DataFrame:
    """(a, b): links among the distinct fingerprints of column fp (long) that
    connect exactly what all pairs within the radius connect.

    Candidates share `kept` of radius + kept blocks. A bucket over `chunk` rows
    is split into chunks by hash and each pair of chunks is a group of its own, so that a task never holds more than about two chunks of one
    bucket, and no pair is skipped. Only spanning links leave a group.
    Null fingerprints link nothing; no rows give no links.
    """
    masks = block_masks(radius + kept, kept)
    # a bucket's key is a hash of table and block value; buckets that share a key by chance are compared in vain
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)]
    blocks = fps.where(F.col("fp").isNotNull()).select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("k"))
    hot = blocks.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > chunk)
    hot = saved(hot.select("k", F.ceil(F.col("m") / chunk).cast("int").alias("n")))
    cold = F.col("n").isNull()
    c, j = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"), F.explode(F.when(cold, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = (
        blocks.join(small_side(hot), "k", "left")
        .select("fp", "k", "n", c.alias("c"), j.alias("j"))
        .select("fp", "k", F.when(cold, 0).otherwise(F.least("c", "j") * F.col("n") + F.greatest("c", "j")).alias("pair"))
    )
    by = ["k", "pair"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, by):
            a, b = spanning_links(group_numbers(batch, by), batch.column("fp").to_numpy().view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long")


def group_numbers(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Ascending numbers of the runs of equal keys."""
    new = np.zeros(batch.num_rows, bool)
    for key in keys:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Sorted batches dealt anew, at least `rows` rows at a time, never cutting a group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.concat_batches(held)
        last = int(np.searchsorted(g := group_numbers(whole, keys), g[-1]))
        if last:
            yield whole.slice(0, last)
        held = [whole.slice(last)]
        n = held[0].num_rows
        rows = max(rows, 2 * n)
    if held and sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def verified_links(
    batches: Iterator[pa.RecordBatch], content: str, radius: int, alike: Callable[[object, object], bool], key_type: pa.DataType,
    keys: list[str],
) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the keys of rows (fp, key, content) whose
    fingerprints are within the radius and whose contents are alike, group by
    group of `keys`. A pair that other links connect already is not compared."""
    for batch in whole_groups(batches, keys, rows=2_000):
        numbers = group_numbers(batch, keys)
        starts = np.r_[np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]), len(numbers)]
        fps = batch.column("fp").to_numpy().view(np.uint64)
        names, contents = batch.column("key").to_pylist(), batch.column(content)
        a, b = [], []
        for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            root = list(range(last - first))
            ready: dict[int, object] = {}

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            def at(i: int, first=first, ready=ready) -> object:
                if i not in ready:
                    ready[i] = contents[first + i].as_py()
                return ready[i]

            for i, j in near_pairs(fps[first:last], radius):
                if (x := top(i)) != (y := top(j)) and alike(at(i), at(j)):
                    root[max(x, y)] = min(x, y)
                    a.append(names[first + i])
                    b.append(names[first + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, key_type), pa.array(b, key_type)], ["a", "b"])
