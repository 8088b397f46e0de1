"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import cut


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect the same nodes as the links (a, b)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        while (jump := new[new]) is not None and not np.array_equal(jump, new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _split(frame: DataFrame, *columns: str) -> DataFrame:
    """The frame with an exchange of its own when it is joined by the first column: its partitioning is hidden
    behind an expression that the optimizer leaves alone, so a join with it is between two plain exchanges,
    which Spark splits when one is skewed."""
    key = columns[0]
    return frame.select(F.element_at(F.array(F.col(key)), 1).alias(key), *columns[1:])


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node (u) is linked to one node only (v), which itself is linked to none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    each = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not each.filter("out > 1 OR (out = 1 AND into = 1)").agg(F.count("*")).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link to another one, with the smallest node of its component.

    Nodes are longs or structs that can be ordered. Large and small stars only replace links within a
    component, and the links end as stars around the smallest nodes. Rounds grow with the logarithm of the
    longest path; each one is cut with a checkpoint, and links that are stars already need none. A hub's links meet in map-side minima and in joins whose
    sides are plain exchanges, so that Spark splits a hub. Null nodes and links of a node to itself are
    ignored; an empty table gives an empty result.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    for _ in range(most_rounds):
        if _are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(_split(lowest, "u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_split(lowest, "u", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
