"""Connected components of a graph of any size.

Edges are contracted within chunks of bounded size first: a chunk's edges
become stars around the least node of each of its components.  A graph of one
chunk is done then; stars of several chunks are joined by alternating
large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save

#: Edges that a task holds at once.
CHUNK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the links a-b to the least node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        # what either end's root learns, all nodes below it learn in the next turns
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v) instead of the edges (u, v) of every chunk."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK:
            u, v = forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held, count = [], 0
    if held:
        u, v = forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the saved edges(a, b): the least node that can be reached.

    Every minimum per node is written before it joins back, so that both sides
    of the join come straight from a shuffle and a hub's rows can be split.
    """
    pairs = edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    chunks = -(-pairs.count() // CHUNK)
    current = save(pairs.coalesce(max(1, chunks)).mapInArrow(_contract, "u long, v long"))
    mark = None
    while chunks > 1:
        both = current.select(F.col("u").alias("x"), F.col("v").alias("y")).union(current.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = save(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = save(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        lower = save(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(moved.union(lower.select("u", F.col("m").alias("v"))).distinct())
        for x in (current, least, large, lower):
            drop(x)
        current, old, mark = after, mark, _mark(after)
        if mark == old:
            break
    root = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root.select("node", F.col("node").alias("component")))
