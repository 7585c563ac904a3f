"""Connected components of an edge table, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import saved


def connected_components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """node and component (the smallest node that can be reached), for each node of the edges (a, b: long).

    Alternating large-star and small-star steps: each hangs every node's
    neighbours on the smallest one, until nothing changes. Each step keeps at
    most one row for each edge, is written to the shared folder, and takes
    about as many rounds as the logarithm of the longest path. Edges may
    repeat, stand in either order or join a node to itself; null ends are
    left out. No edges, no rows. made gets the paths of the tables written,
    which the result is read from.
    """
    pairs = edges.where("a is not null and b is not null and a != b")
    now = saved(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges", made)
    before = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = saved(_small_star(_large_star(now)), "edges", made)
    below = now.groupBy("v").agg(F.min("u").alias("u"))
    roots = now.select("u").distinct().withColumnRenamed("u", "v").withColumn("u", F.col("v"))
    return below.union(roots).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    greater = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))  # w > v: the larger neighbours
    return greater.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(least.select("v", F.col("m").alias("u"))).distinct()
