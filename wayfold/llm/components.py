"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root): root is the smallest node reachable; nodes without an edge do not occur.

    Each step minimises over a node's neighbours with partial aggregation and joins the minimum back, so a node
    with a third of all edges is pre-aggregated and its join side can be split; nothing gathers a neighbour list.
    Self edges and null ends are ignored, repeated edges count once.
    """
    edges = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _fingerprint(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(large, "large-star")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "small-star")
        now = _fingerprint(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
