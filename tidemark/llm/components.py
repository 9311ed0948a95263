"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges`` (columns ``a``, ``b``); the root is the smallest node of its component.

    A round links larger neighbours, then smaller ones, to the smallest neighbour. Minima are pre-aggregated, and a node with
    very many edges is dealt in parts where they are joined back. Ends when a round changes nothing; a round's table goes when the next
    one is written.
    """
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, mark = now.count(), None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both, low, "a", "n", 2 * n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "a", "n", n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialize(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(now)
        now = new
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = mark[0]
        if was == mark:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
