"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b.

    Each step needs only the least neighbour of a vertex (a map-side combined minimum) and a join, so that a vertex
    of very many neighbours is never gathered anywhere.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a != b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of orderable ids to (vertex, root): root is the least id that a vertex can reach.

    Loops, repeated edges and either direction are fine; rows with a null end are no edges. A vertex that is its own
    root isn't returned, so an empty table gives an empty table. Only a count and a checksum go to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges, seen = cut(edges), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen, edges = now, cut(_contract(edges))
