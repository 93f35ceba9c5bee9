"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import discard, gathered, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Hang every larger neighbour of a node below the smallest in its neighbourhood."""
    near = _both_ways(edges)
    least = gathered(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows)
    moved = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return gathered(moved, rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = gathered(down.groupBy("u").agg(F.min("v").alias("m")), rows)
    moved = gathered(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows)
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node reachable.

    Loops and repeated links are allowed, nulls are not.  Every round is written to the shared
    folder, so a lost executor costs one round at most, and the round before is deleted; the number
    of rounds grows with the logarithm of the longest chain.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    edges = materialize(gathered(edges, links.count()), "links")
    state, rows = None, edges.count()
    while True:
        star = _small_star(_large_star(edges, rows), rows).filter("u <> v").distinct()
        before, edges = edges, materialize(gathered(star, rows), "stars")
        discard(before)
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if now == state:
            break
        state, rows = now, max(1, now["n"])
    roots = gathered(edges.select(F.col("v").alias("node")).distinct(), rows)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
