"""Connected components of a link table, and spanning forests inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import stored


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and links a[i]-b[i], the smallest node each one reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over unique (hi, lo) rows.

    A node's smallest neighbour is found by an aggregate that combines before the shuffle and
    is joined back on a recomputed key, which gives the join an exchange on either side, so a
    node with very many links can be split.
    """
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + F.lit(0)).alias("c"), F.least("m", "u").alias("m"))
    large = both.where("v > u").join(lowest, F.col("u") == F.col("c")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m")).select((F.col("hi") + F.lit(0)).alias("c"), "m")
    joined = large.join(least, F.col("hi") == F.col("c"))
    small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(joined.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (``a``, ``b`` long); component: the smallest node reached.

    Large-star and small-star steps alternate until nothing changes; each round is a written
    table.  Loops and nulls are ignored.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if now == state or now[0] == 0:
            break
        state, edges = now, stored(_stars(edges), "stars")
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
