"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, release


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task -> ``(node, smallest node of its component)`` for all nodes but the smallest: at most one row a node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``a, b`` links (any order, repeats allowed) -> ``node, root``: root is the smallest node that links reach.

    Nodes without a link to another are absent. Alternates the two star steps of Kiveris et al. (2014): each joins every
    node's neighbours with the smallest of them, so links never outnumber those given and a hub is a skewed join, not one
    task's list. Each round is checkpointed; the driver sees two numbers a round.
    """
    spark = links.sparkSession
    edges = cut(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first())

    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.withColumnRenamed("lo", "u").join(least, "u").select("hi", F.col("m").alias("lo")).distinct()
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("e"))
        edges = cut(small.select("e.hi", "e.lo").where("hi > lo").distinct())
        after = state(edges)
        release(spark)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
