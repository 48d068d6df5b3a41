"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, scratch, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges`` with another one; component is the smallest node.

    Each round joins the edges with each node's smallest neighbour.  A hub's rows are summed before the
    shuffle, and the joins are plain equality joins whose large partitions Spark splits.  Each round is
    written to the shared folder, so that a lost executor costs one round, and leaves nothing in the driver.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    path = scratch(edges.sparkSession, "edges")
    now = stored(now, "edges", path)
    before = None
    while True:
        # Large star: neighbours above a node go to the smallest neighbour (or the node itself).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: neighbours below a node go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, path = path, scratch(edges.sparkSession, "edges")
        now = stored(small, "edges", path)
        dropped(edges.sparkSession, last)
        released(edges.sparkSession)
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (sums.n, sums.h):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = (sums.n, sums.h)
