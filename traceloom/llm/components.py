"""Distributed union-find over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every child (a) has one parent (b) that is no child itself, which makes the parent the smallest of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return ends.filter((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("parent") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round, stored."""
    return materialize(_small_star(materialize(_large_star(edges).distinct(), "star")).distinct(), "star")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(item, root): the smallest item reachable from each linked item, over links (a, b).

    Alternates large-star and small-star rounds until each component is one star, which takes about the logarithm of the longest
    path.  Each round sends a node's edges by partial aggregates and joins with one row per node, so a hub is split
    like any skewed join.  With ``rounds`` given it stops early: equal roots then still mean one component,
    but different roots no longer mean two.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(down.filter("a <> b").distinct(), "links")
    while (rounds is None or rounds > 0) and not _settled(edges):
        edges = step(edges)
        rounds = None if rounds is None else rounds - 1
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "item").union(
        edges.select("b").distinct().join(edges.select("a").distinct().withColumnRenamed("a", "b"), "b", "left_anti").select(F.col("b"), F.col("b"))
    )
