"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from auditlake.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node it can reach.

    A large star hangs a node's larger neighbours on its smallest one, a small star the smaller
    ones; repeated in turn, every component becomes a star around its smallest node after a
    logarithmic number of rounds; edges that are stars already take one, no edges none. Minima are taken before the shuffle, so a node with very many
    edges costs one row per task. An empty table gives an empty table; repeated edges, loops and
    either direction are allowed.
    """
    now = written(_oriented(edges), "edges")
    before, state = None, _state(now)
    while state[0] and state != before:
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return leaves.union(roots).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> Row:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pair.distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return up.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
