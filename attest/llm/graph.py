"""Connected components by alternating large-star and small-star steps; every step is a pair of joins, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _towards_least(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("c"))
    if small:
        out = met.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("c").alias("x"), "m"))
    else:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return out.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (a, b), in any direction, with loops and repeats: (id, component), the least id reachable, for each id that is not its own least. Rounds grow with the logarithm of the longest path."""
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    mark = told(now)
    for _ in range(most_rounds):
        if not mark["n"]:
            break
        last, now = now, written(_towards_least(_towards_least(now, small=False), small=True), "edges")
        before, mark = mark, told(now)
        forget(last)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
