"""Connected components of an edge table, entirely in Spark: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SALT = 8  # parts that a node's edges are dealt to where they meet its minimum


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges joined with (a, m) on a, each node's edges in SALT parts, as a hub may have a third of them."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    copies = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, ["a", "_s"]).drop("_s")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges: two long columns a and b without nulls, in any direction, repeats and loops allowed. An empty
    table gives an empty result. Only a count and a checksum reach the driver in each round; each round
    is written to the shared folder, so a lost executor repeats one round at most. Hub nodes are
    pre-aggregated before the shuffle, and salted where their edges are joined.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", narrow=True)
    mark = None
    for _ in range(max_rounds):
        then = now
        now = materialize(_small_star(_large_star(then)).distinct(), "edges", narrow=True)
        discard(then)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
