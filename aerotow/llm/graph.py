"""Connected components of an edge table by alternating large-star and small-star steps, all as grouped joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours get linked to the least node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours get linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its least node.

    Each round is written to the shared folder; the rounds grow with the logarithm of the longest chain.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == state:
            break
        state = (mark.n, mark.h)
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
