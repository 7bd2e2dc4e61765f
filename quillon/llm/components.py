"""Connected components: a numpy kernel for one task, and alternating stars for the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_scratch, materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of the component of each of 0..n-1, for edges a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps alternate; each halves the depth of the trees, so rounds
    grow with the logarithm of the longest chain. Every round is written to shared storage.
    Self loops and repeated edges are harmless; an edge with a null end is ignored; no edges
    give no rows.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def large_star(df: DataFrame) -> DataFrame:
        both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(df: DataFrame) -> DataFrame:
        low = written(df.groupBy("a").agg(F.min("b").alias("m")))
        return df.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.m").alias("b"))

    spent: list[DataFrame] = []

    def written(low: DataFrame) -> DataFrame:
        """A star's centre has one row here and as many as its leaves on the join's other side, which Spark can split once this is a table."""
        spent.append(materialize(low, "least-neighbours"))
        return spent[-1]

    now = materialize(oriented(edges), "edges")
    for _ in range(max_rounds):
        # a forest of stars has no node that is both a leaf and a centre, and one centre a leaf
        state = now.groupBy("a").agg(F.count("*").alias("n"))
        if state.where("n > 1").isEmpty() and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
        after = materialize(oriented(small_star(oriented(large_star(now)))), "edges")
        for old in (now, *spent):
            drop_scratch(old)
        spent.clear()
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def labels(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) for nodes (node, least), one row a node: the smallest `least` of its component. roots is what connected_components gave."""
    rooted = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return rooted.join(least, "root").select("node", "component_id")
