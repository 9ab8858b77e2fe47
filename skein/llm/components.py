"""Connected components by alternating large-star and small-star steps, without a hub in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (a, b) of longs: node, root (the smallest node of its component). Loops and repeated edges do no harm."""
    now = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (sign["n"], sign["s"]):
            return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).union(now.select(F.least("a", "b"), F.least("a", "b"))).groupBy("node").agg(F.min("root").alias("root"))
        before = (sign["n"], sign["s"])
        now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
