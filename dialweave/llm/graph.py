"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.session import freeze


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of `edges` (a, b).

    Alternates two rounds, each of which hangs nodes on a smaller neighbour and
    keeps reachability, until every edge points at its root; the number of rounds
    grows with the logarithm of the longest path. A node with very many edges is
    pre-aggregated, and its join can be split. Nulls must have been removed.
    """
    edges = freeze(_downward(edges.select("a", "b")))
    seen = _print(edges)
    while seen[0]:
        edges = freeze(_hang_lower(_hang_higher(edges)))
        now = _print(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _hang_higher(edges: DataFrame) -> DataFrame:
    """Every higher neighbour of a node goes to the node's smallest neighbour, or to the node."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _downward(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _hang_lower(edges: DataFrame) -> DataFrame:
    """Every lower neighbour of a node, and the node, go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(lower.union(least.select("a", F.col("m").alias("b"))))
