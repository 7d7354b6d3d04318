"""Spelling variants: words one edit apart, found on a trie that is a table.

The trie has no object anywhere: it is a table of edges (depth, node, letter,
child), a node being the hash of the prefix that leads to it. A state (word,
position, node, edits) says that a word has been read up to a position and
that the trie is at a node; one join a level with that level's edges moves all
states one letter down. A state that has read its whole word with one edit is
a neighbour, if its node is a word.

Two directions halve the work: edits in a word's second half are looked for in
the trie of the words, those in its first half in the trie of the reversed
words. So a state starts in the middle of its word, where the trie is thin.
Every edge carries a signature of what can follow below it (64 bits, one set by
each ending), and a state whose remaining letters are not among them is not
made. Collisions of either hash let states through that the last, exact
comparison rejects; they never lose one.

Levels are as many as letters in a word. Words above LONGEST letters meet by
the hashes of what is left when one letter is taken out: those that share such
a rest at the same place are one letter apart, so that no group is larger than
the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, saved, work_folder, written

#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF.
LETTER = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters a word has at least, and how often it occurs at least.
SHORTEST, RAREST = 7, 2
#: A word's form is this many times as frequent as the word.
TIMES = 10
#: Letters of the longest words that walk the trie.
LONGEST = 48
STATE = "word string, way int, pos int, node long, done boolean"


def words_of(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n): the distinct words of doc_id, text.

    One letter of a run goes where the checksum of `<doc_id>:<run>` is a
    multiple of 31 (a null doc_id is written as nothing). Null and empty texts
    have no words; repeated rows count each.
    """
    # a run below the least length cannot become a word, since letters only go
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0)))
    run = docs.select("doc_id", runs.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = run.select("run", F.crc32(named.cast("binary")).alias("h"), F.length("run").alias("size"))
    at = F.pmod("h", "size").cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = hashed.select(F.when(F.col("h") % 31 == 0, without).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def node_of(way: Column, prefix: Column) -> Column:
    return F.xxhash64(way, prefix)


def mark_of(ending: Column) -> Column:
    """The number of an ending's bit in a signature."""
    return F.xxhash64(ending).bitwiseAND(F.lit(63)).cast("int")


def rest(word: Column, pos: Column) -> Column:
    """The letters from a position on, counted from 0."""
    return F.substring(word, pos + 1, F.lit(LONGEST + 1))


def both_ways(words: DataFrame) -> DataFrame:
    """Each word (word, way, size, middle), as it is and reversed. A place of
    an edit lies at or behind `middle` in one of the two."""
    size = F.length("word")
    there = words.select("word", F.lit(0).alias("way"), size.alias("size"), F.floor(size / 2).cast("int").alias("middle"))
    back = words.select(F.reverse("word").alias("word"), F.lit(1).alias("way"), size.alias("size"), F.ceil(size / 2).cast("int").alias("middle"))
    return there.unionByName(back)


def edges_of(ways: DataFrame, first: int) -> DataFrame:
    """(depth, node, letter, child, ends): the edges at depth `first` and below it, with their signatures."""
    depth = F.explode(F.sequence(F.lit(first), F.col("size") - 1))
    at = ways.where(F.col("size") > first).select("word", "way", depth.alias("depth"))
    edges = at.select(
        "depth",
        node_of(F.col("way"), F.substring("word", F.lit(1), F.col("depth"))).alias("node"),
        F.substring("word", F.col("depth") + 1, F.lit(1)).alias("letter"),
        node_of(F.col("way"), F.substring("word", F.lit(1), F.col("depth") + 1)).alias("child"),
        F.call_function("shiftleft", F.lit(1).cast("long"), mark_of(rest(F.col("word"), F.col("depth") + 1))).alias("bit"),
    )
    return edges.groupBy("depth", "node", "letter", "child").agg(F.bit_or("bit").alias("ends"))


def stepped(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level down. States without an edit are given for every
    word at its own place, so that only states with one are made here.

    A letter added to a run of its like, or taken from one, is that behind or
    at the end of the run, so that no state is made twice. A node has no more
    edges than there are letters: the edges of a partition are its hash table."""
    word, pos, letter = F.col("word"), F.col("pos"), F.col("letter")
    own = lambda k: F.substring(word, pos + (k + 1), F.lit(1))
    # the bits of the endings from pos, pos + 1 and pos + 2, six digits each, so that they are hashed once a state and not once an edge
    marks = [F.shiftleft(mark_of(rest(word, pos + k)), 6 * k) for k in range(3)]
    marked = states.select("word", "way", "pos", "edits", F.col("node").alias("parent"), marks[0].bitwiseOR(marks[1]).bitwiseOR(marks[2]).alias("marks"))
    met = marked.join(edges.hint("shuffle_hash"), F.col("parent") == F.col("node"))

    def may(k: int) -> Column:
        at = F.shiftright("marks", 6 * k).bitwiseAND(F.lit(63))
        return F.call_function("shiftright", F.col("ends"), at).bitwiseAND(F.lit(1).cast("long")) == 1

    clean = F.col("edits") == 0
    own_letter = letter == own(0)
    on = may(1) & (~clean & own_letter | clean & ~own_letter & (pos < F.length(word)))  # read on, or replaced
    more = clean & ~own_letter & may(0)  # one letter more in the trie; behind the end there is no own letter
    less = clean & ~own_letter & may(2) & (letter == own(1))  # one letter less, then read on
    to = F.array_compact(F.array(F.when(on, pos + 1), F.when(more, pos), F.when(less, pos + 2)))
    moved = met.where(on | more | less).select("word", "way", F.explode(to).alias("pos"), F.col("child").alias("node"))
    return moved.withColumn("done", F.col("pos") == F.length("word"))


def walked(words: DataFrame, folder: str) -> DataFrame:
    """(word, near): pairs of words of LONGEST letters or fewer that one edit parts, both directions of each."""
    spark = words.sparkSession
    ways = both_ways(words)
    sizes = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    if sizes[0] is None:
        return spark.createDataFrame([], "word string, near string")
    least, most = sizes[0] // 2, sizes[1]
    edges = written(edges_of(ways, least), f"{folder}/edges", "depth")
    levels = []
    below = spark.createDataFrame([], STATE)
    for depth in range(least, most + 1):
        clean = ways.where((F.col("middle") <= depth) & (F.col("size") >= depth)).select(
            "word", "way", F.lit(depth).alias("pos"), node_of(F.col("way"), F.substring("word", 1, depth)).alias("node"), F.lit(0).alias("edits")
        )
        edited = below.where(~F.col("done")).select("word", "way", "pos", "node", F.lit(1).alias("edits"))
        here = edges.where(F.col("depth") == depth).select("node", "letter", "child", "ends")
        levels.append(written(stepped(clean.unionByName(edited), here), f"{folder}/level-{depth}", "done"))
        if depth > least:
            dropped(spark, f"{folder}/level-{depth - 1}/done=false")
        below = levels[-1]
    # a word without its last letter is at its own prefix's node
    shorter = F.substring("word", F.lit(1), F.col("size") - 1)
    found = ways.where(F.col("size") > sizes[0]).select("word", "way", node_of(F.col("way"), shorter).alias("node"))
    for level in levels:
        found = found.unionByName(level.where("done").select("word", "way", "node"))
    ends = ways.select(F.col("word").alias("near"), node_of(F.col("way"), F.col("word")).alias("node"))
    pairs = found.join(ends, "node").where(F.levenshtein("word", "near", 1) == 1)
    turned = lambda c: F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c))
    return pairs.select(turned("word").alias("word"), turned("near").alias("near")).distinct()


#: Two primes and two bases; a rest's hash is made of both remainders.
FIELDS = ((2147483647, 1000003), (2147483629, 998244))
RESTS = "id long, place long, rest long, whole boolean"


def _sums(codes: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes: of all rests after one letter, and (one value) of the whole."""
    powers = np.ones(len(codes), np.int64)
    n = 1
    step = base % prime
    while n < len(codes):
        m = min(n, len(codes) - n)
        powers[n : n + m] = powers[:m] * step % prime
        step = step * step % prime
        n *= 2
    upto = np.cumsum(codes * powers % prime) % prime
    before = np.concatenate([[0], upto[:-1]])
    behind = (upto[-1] - upto) % prime * pow(base, -1, prime) % prime
    return (before + behind) % prime, upto[-1:]


def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each long word (id, word): its own hash, and that of each rest with its place and without one (place -1)."""
    schema = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("rest", pa.int64()), ("whole", pa.bool_())])
    for batch in batches:
        for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
            (a, wa), (b, wb) = (_sums(codes, *f) for f in FIELDS)
            gone, own = a << 31 ^ b, wa << 31 ^ wb
            once = np.unique(gone)
            n = len(gone) + len(once) + 1
            place = np.concatenate([np.arange(len(gone)), np.full(len(once) + 1, -1)])
            whole = np.zeros(n, bool)
            whole[-1] = True
            values = [np.full(n, key), place, np.concatenate([gone, once, own]), whole]
            for k in range(0, n, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)]) for v in values], schema=schema)


def _same_start(a: str, b: str) -> int:
    """Letters that two words share from the start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one edit makes b of a; linear in their length."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = _same_start(a, b)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("word").to_pylist(), batch.column("near").to_pylist()
        yield batch.filter(pa.array([one_apart(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))


def long_pairs(words: DataFrame) -> DataFrame:
    """(word, near): pairs one edit apart of which one has more than LONGEST letters."""
    some = words.where(F.length("word") >= LONGEST).select(F.xxhash64("word").alias("id"), "word")
    made = saved(some.mapInArrow(rests, RESTS))
    placed = made.where(F.col("place") >= 0).select("place", "rest", "id")
    replaced = placed.join(placed.withColumnRenamed("id", "other"), ["place", "rest"]).select("id", "other")
    free = made.where(F.col("place") < 0)
    wholes = free.where("whole").select("rest", F.col("id").alias("other"))
    less = free.where(~F.col("whole")).select("rest", "id").join(wholes, "rest").select("id", "other")
    both = less.unionByName(less.select(F.col("other").alias("id"), F.col("id").alias("other"))).unionByName(replaced)
    pairs = both.where("id != other").distinct()
    pairs = pairs.join(some, "id").join(some.select(F.col("id").alias("other"), F.col("word").alias("near")), "other").select("word", "near")
    return pairs.where(F.greatest(F.length("word"), F.length("near")) > LONGEST).mapInArrow(_checked, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; each is TIMES as frequent as
    the one before, so that a few doublings reach it."""
    reached = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = saved(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if following.where("moved").isEmpty():
            return following.select("word", "root")
        reached = following.drop("moved")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of doc_id, text.

    Near words differ by exactly one inserted, deleted or replaced letter. The
    form is the most frequent near word (of equal ones the first in code-point
    order), if it is `times` as frequent. Null and empty texts hold no word, an
    empty table gives an empty table; other columns are not read.
    """
    if shortest < 2:
        raise ValueError("words need two letters or more")
    spark: SparkSession = docs.sparkSession
    folder = work_folder(spark, "spelling")
    words = written(words_of(docs, shortest, rarest), f"{folder}/words")
    short = walked(words.where(F.length("word") <= LONGEST), folder)
    pairs = short.unionByName(long_pairs(words)).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    all_words = words.join(near, "word", "left")
    has = -F.col("best.less") >= times * F.col("n")
    graded = written(
        all_words.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"),
        ),
        f"{folder}/graded",
    )
    last = roots(graded.where("form is not null"))
    return graded.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
