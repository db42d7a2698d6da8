"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large(e: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    pairs = _both(e)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """u and every neighbour below it are tied to the least of them; a < b in every row of e."""
    least = e.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
    kept = e.join(least, F.col("b") == F.col("w")).select("a", "b", "m")
    tied = kept.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(kept.select(F.col("m").alias("a"), "b"))
    return tied.where("a < b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node with an edge; edges have a and b.

    Rounds grow with the logarithm of the longest path squared at most. Neighbours are never gathered: each step is an
    aggregate with map-side sums and a join whose large keys can be split. Every round is written to the shared folder.
    """
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sign["n"] == 0 or sign == before:
            break
        before = sign
        last, e = e, saved(_small(_large(e)), "edges")
        drop_saved(last)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
