"""Connected components of an edge table by alternating local union-find and star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.llm.storage import Scratch

EDGE = "u long, v long"


def _forest(batches):
    """Union-find over one partition's edges: each node points to the least node it reaches here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.record_batch({"u": np.array(part, np.int64), "v": np.array([find(x) for x in part], np.int64)})


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of those."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u")
    return moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node that has an edge to another node; component is the least id.

    edges: columns u and v; loops and repeats do no harm and an empty table gives an empty result.
    No group is gathered: each round is partial aggregates and joins that may be split, and stops
    when a round changes nothing (a logarithmic number of rounds).
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = scratch.table(e.mapInArrow(_forest, EDGE), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.count_distinct("u")).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen, old = state, e
        e = scratch.table(_small_star(_large_star(e).distinct()).distinct(), "edges")
        scratch.drop(old)
