"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches.

    ``edges`` has columns a and b of one orderable type.  Each round hangs every node's larger neighbours on its
    smallest one (large star), then its smaller neighbours (small star), both as a minimum per node with a partial
    aggregate and one join; a hub's edges are never gathered.  The table is written between rounds, so lineage stays
    short, and the rounds end when the edges stop changing: a logarithmic number for trees, chains included.
    Self-loops and repeated edges are fine, rows with a null end are ignored, no edges give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = written(pairs, "cc")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large star: neighbours above a move to the lowest of a and its neighbours
        large = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "cc")
        # small star: a and its lower neighbours move to the lowest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        current = written(moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "cc")
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast(T.DecimalType(38, 0))), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
