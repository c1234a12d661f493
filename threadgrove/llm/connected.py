"""Connected components of an edge table, by alternating star steps; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadgrove.session import stored


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """Large star: every larger neighbour of u is tied to u's smallest. Small star: u and its smaller ones are."""
    if upward:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        tied = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        tied = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(low.select("u", F.col("low").alias("v")))
    return tied.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge (u, v), the smallest node it is connected to, the roots left out.

    The number of rounds grows with the logarithm of the longest path. An empty table gives an empty one.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    seen = None
    while True:
        now = stored(_stars(stored(_stars(now, True)), False))
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if (facts["n"], facts["x"]) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (facts["n"], facts["x"])
