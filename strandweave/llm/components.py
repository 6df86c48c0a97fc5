"""Connected components of an edge table, by alternating large and small stars.

Nothing is collected: each step aggregates a minimum per node (map-side combine,
so a hub with very many edges is one partial row per task) and joins it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges point from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
    moved = edges.join(least, F.col("u") == F.col("x"))
    down = moved.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple:
    """Edges, and how many nodes are on both ends or have two parents: none in a forest of stars."""
    up = edges.groupBy("u").agg(F.count("*").alias("parents"))
    inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return up.filter("parents > 1").isEmpty() and inner.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: the smallest node reachable, for every node of a link other than the smallest itself."""
    edges = materialise(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _shape(edges):
        before, edges = edges, materialise(_small_star(_large_star(edges)), "stars")
        release(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
