"""Connected components by rounds of local contraction.

In each round every edge goes to where its larger end is the key and to where
its smaller end is, each task unites what it holds and links every node to the
smallest of its part. No component is gathered in one task or on the driver:
the edges of a hub, which is the smaller end of more than PLACE, are dealt by
their larger end over as many places as they need, and the hub's own edges
downwards go to all of them. All other nodes have one place, so that an edge
is two rows, however many places a hub has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side

#: Edges of one node that stand in one place, on average; a node with more has more places.
PLACE = 2048
#: Edges that a task unites at a time; what they link is what the next take up.
AT_ONCE = 1 << 20


def united(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) for each node that is not the smallest.

    Pointer jumping on whole arrays: every node takes the smallest label of
    its neighbours, and labels are shortened until nothing changes.
    """
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
        if np.array_equal(was, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo): each node of the task's edges linked to the smallest of its part."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, most = 0, AT_ONCE
    for batch in batches:
        held.append((batch.column("hi").to_numpy(), batch.column("lo").to_numpy()))
        n += batch.num_rows
        if n >= most:
            held = [united(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
            most = max(AT_ONCE, 2 * n)
    if held:
        hi, lo = united(*map(np.concatenate, zip(*held, strict=True)))
        for k in range(0, len(hi), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(hi[k : k + (1 << 18)]), pa.array(lo[k : k + (1 << 18)])], ["hi", "lo"])


def _shape(edges: DataFrame) -> tuple[int, int, int, int, int]:
    """Of the edge set: its size and the xor of its hashes, the most smaller ends
    of one node, how many nodes are both a larger and a smaller end, and how many hubs there are."""
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"))))
    by_node = edges.select(ends.alias("e"), F.xxhash64("hi", "lo").alias("x")).groupBy("e.node").agg(
        F.sum("e.up").alias("up"), F.sum(1 - F.col("e.up")).alias("down"), F.expr("bit_xor(x) FILTER (WHERE e.up = 1)").alias("x")
    )
    both, hub = F.col("up") * F.col("down") > 0, F.col("down") > PLACE
    n, x, up, between, hubs = by_node.agg(F.sum("up"), F.bit_xor("x"), F.max("up"), F.count_if(both), F.count_if(hub)).first()
    return n or 0, x or 0, up or 0, between, hubs


def _dealt(current: DataFrame, n_hubs: int | None = None) -> DataFrame:
    """(hi, lo, key, salt): each edge at one place of its smaller end, and at
    every place of its larger end, which is one unless that is a hub. n_hubs:
    how many hubs there are, where that is known; without any nothing is looked for."""
    edges, one = current, F.lit(1)
    lo_places, hi_places = one, one
    if n_hubs != 0:
        hubs = current.groupBy("lo").agg(F.count("*").alias("n")).where(F.col("n") > PLACE)
        hubs = saved(hubs.select(F.col("lo").alias("hub"), F.ceil(F.col("n") / PLACE).cast("int").alias("places")))
        of = lambda end: small_side(hubs.select(F.col("hub").alias(end), F.col("places").alias(f"{end}_places")), n=n_hubs)
        edges = current.join(of("lo"), "lo", "left").join(of("hi"), "hi", "left")
        lo_places, hi_places = F.coalesce("lo_places", one), F.coalesce("hi_places", one)
    below = F.struct(F.col("lo").alias("key"), F.pmod(F.xxhash64("hi"), lo_places).cast("int").alias("salt"))
    above = F.transform(F.sequence(F.lit(0), hi_places - 1), lambda s: F.struct(F.col("hi").alias("key"), s.alias("salt")))
    return edges.select("hi", "lo", F.explode(F.concat(F.array(below), above)).alias("at")).select("hi", "lo", "at.key", "at.salt")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable.

    Nodes are long integers. Self-loops, repeated edges, either direction and
    null ends are allowed: a row with a null end or equal ends links nothing
    and is left out. No edges give an empty table. The loop ends when all edges
    are stars around roots: no node has two smaller ends, none is both a larger
    and a smaller end. Each round's shape also tells whether there are hubs, so
    that one without them looks for none.
    """
    ends = F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")
    given = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = saved(given.select(*ends).mapInArrow(contracted, "hi long, lo long").distinct())
    shape = _shape(current)
    for _ in range(max_rounds):
        if shape[2] <= 1 and not shape[3]:
            break
        dealt = _dealt(current, shape[4]).repartition("key", "salt").select("hi", "lo")
        current = saved(dealt.mapInArrow(contracted, "hi long, lo long").distinct())
        was, shape = shape, _shape(current)
        if was == shape:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())
