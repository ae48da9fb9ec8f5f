"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import Stored, store

#: Links up to which the driver finds the components by itself, in arrays of 8 MB; more take the rounds of joins.
DRIVER_LINKS = 1 << 19


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links in order, and the smallest one that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(one):
        # the greater root of each link hangs on the least that it meets, then every node on its root
        np.minimum.at(root, np.maximum(root[one], root[two]), np.minimum(root[one], root[two]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    return nodes, nodes[root]


def components(links: DataFrame, name: str = "links", driver_links: int = DRIVER_LINKS) -> Stored:
    """`links` (a, b long) to a written table (node, component), the component being the smallest node reachable,
    for every node but the components themselves.

    Up to `driver_links` distinct links are one array of the driver: for so few, the rounds would be hundreds of nearly
    empty tasks. For more, large-star and small-star steps in turn until only stars are left: no node with two smaller ones, and no centre with a
    smaller one. Each takes the least neighbour of every node, combined before the shuffle and written, and joins it back:
    both sides of the join are plain scans, so Spark can broadcast a small one and split a node with very many links; no
    node's links ever meet in one task as a list.
    Links of a node with itself, repeated links and nulls say nothing. Nodes without links are not in the result.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    if edges.df.count() <= driver_links:
        got = edges.df.toArrow()
        node, least = least_reachable(*(got.column(c).to_numpy() for c in ("lo", "hi")))
        edges.drop()
        below = node != least
        return store(links.sparkSession.createDataFrame(pa.table({"node": node[below], "component": least[below]})), name)
    while not _are_stars(edges.df):
        both = edges.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.df.select("lo", "hi"))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(least.df, F.col("u") == F.col("w")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = store(large.distinct(), name)
        low = store(large.df.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "h"), name)
        small = large.df.join(low.df, F.col("hi") == F.col("h"))
        star = small.select("hi", F.col("m").alias("lo")).union(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        after = store(star.distinct(), name)
        for gone in (edges, least, large, low):
            gone.drop()
        edges = after
    edges.df = edges.df.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return edges


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("centre")).union(edges.select("lo", F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"))
    return per.agg(F.max((F.col("up") > 1) | (F.col("up") == 1) & (F.col("centre") == 1))).first()[0] is not True
