"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import discard, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Large-star and small-star steps: the neighbours of a node move to the least of them."""
    seen = _both(edges) if larger else edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = (
        seen.join(least, "a")
        .where((F.col("b") > F.col("a")) if larger else (F.col("b") != F.col("least")))
        .select(F.col("b").alias("x"), "least")
    )
    if not larger:
        moved = moved.union(least.select(F.col("a").alias("x"), "least"))
    return (
        moved.where(F.col("x") != F.col("least"))
        .select(
            F.greatest("x", "least").alias("a"),
            F.least("x", "least").alias("b"),
        )
        .distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether each greater end of the edges (a > b) has one edge and is no lesser end: the lesser
    ends are the least nodes of their components then."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 OR up = 1 AND down = 1").head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the least node of its component.

    Alternating stars end after a number of rounds that grows with the logarithm of the number
    of nodes, as soon as all that is left are stars: no round is spent on seeing that nothing
    changes. Each round is written to the shared folder; the groups of a node are only reduced to
    their least member, never collected.
    """
    spark = edges.sparkSession
    now = stored(
        spark,
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )

    while not _are_stars(now):
        last, now = now, stored(
            spark, _towards_least(_towards_least(now, larger=True), larger=False), "edges"
        )
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
