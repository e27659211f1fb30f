"""Connected components by alternating large and small stars, in DataFrame operations; of few edges on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LOCAL = 1_000_000  #: edges (two longs each) that are joined on the driver at most, as each step of stars writes files for every task


def _joined(edges: DataFrame) -> DataFrame:
    """node and root as of `components`: the roots of two ends hook the greater to the lesser, until both are the same."""
    got = edges.toArrow()
    nodes, at = np.unique(np.concatenate([got[c].to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = at[: len(got)], at[len(got) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes[root]}), "node long, root long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node it is linked with) of every node of an edge.

    Each star step links the neighbours of a node to the least of them; a component ends as a star around its root. The
    steps shuffle one row per edge at most, and edges only get fewer. Up to LOCAL edges are joined on the driver instead, with
    the same result. Nulls link nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = cut(e)
    if e.count() <= LOCAL:
        return _joined(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("x"), "m").filter("x > m")
        new = cut(small.union(least).toDF("u", "v").distinct())
        # at rest every node has one edge, and it goes to a node that has none
        tied = new.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        if tied == 1 and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        e = new
    return new.toDF("node", "root").union(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
