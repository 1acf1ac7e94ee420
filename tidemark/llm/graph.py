"""Connected components of link tables by alternating star contractions.

No partition or driver ever holds a whole component: each round replaces links by links to the
smallest known neighbour (first for larger, then for smaller neighbours) until nothing changes.
Links found inside of one task should come as stars, made by a union-find in that task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import Scratch


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Union-find over links a-b of nodes 0..n-1: each node's smallest reachable node."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:  # path halving for all nodes at once
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _large(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written apart, so that both sides of the join are plain shuffles, whose hot keys Spark can split
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    least = scratch.write(links.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
    joined = links.join(least, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, component (its smallest reachable node) of all nodes of ``links`` (a, b); loops are ignored."""
    now = scratch.write(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    mark, k = print_of(now), 0
    while mark[0]:
        large = scratch.write(_large(now, scratch, f"{name}-{k}-large"), f"{name}-{k}-large")
        after = scratch.write(_small(large, scratch, f"{name}-{k}-small"), f"{name}-{k + 1}")
        new = print_of(after)
        scratch.drop(f"{name}-{k}", f"{name}-{k}-large", f"{name}-{k}-large-least", f"{name}-{k}-small-least")
        now, k, mark, old = after, k + 1, new, mark
        if new == old:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
