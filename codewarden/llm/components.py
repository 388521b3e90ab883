"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.session import cut_lineage


def _minima(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))  # read back: a join with it can be split


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    A round replaces each node's links by links to its smallest neighbour, first upwards, then
    downwards, until nothing changes; the number of rounds grows as the logarithm of a component's
    size. A node's links are never gathered: minima combine before the shuffle, and the join with them
    is a plain inner join that adaptive execution splits at a hot node.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut_lineage(now)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = _minima(both).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = cut_lineage(up)
        lows = _minima(up)
        joined = up.join(lows, "u")
        down = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(down)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)
