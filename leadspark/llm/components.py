"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Each step keeps as many edges as it gets or fewer and holds only edges (u, v) with u > v. A large-star step links the
larger neighbours of each node to its least neighbour, a small-star step the smaller ones; in the end every node but
the least of its component is linked to that one alone. The least neighbours are written before they
are joined, so both sides of each join are plain exchanges and Spark splits the partition of a hub by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _is_done(e: DataFrame) -> bool:
    """Is each node linked to one other at most, and none of those to a further one?"""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return not ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or below = 1 and above = 1").limit(1).count()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node. Null ends and loops are no edges."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    while not _is_done(e):
        around = e.select(F.col("v").alias("x"), F.least("u", "v").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = written(around.groupBy("x").agg(F.min("y").alias("m")))  # a node's least neighbour, or itself
        large = written(e.join(least, e.v == least.x).select("u", F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"))
        met = large.join(least, large.u == least.x).select("u", "v", "m")
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        e = written(small.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
