"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``edges`` (``a``, ``b``, whole numbers).

    Alternating large-star and small-star steps: each joins the edges with one
    minimum per node, so a node with very many links is only one hot key of a
    join, which adaptive execution splits.  Each round is written to the
    shared folder; the driver sees a count and a sum.  The number of rounds
    grows with the logarithm of the longest path.
    """
    current = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        current = settle(_small_star(_large_star(current)), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    # stars: every u has one v, and v is the smallest node
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Neighbours above a node are linked to the smallest of its neighbourhood."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    lowest = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
    return both.filter("y > x").join(lowest, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    lowest = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
