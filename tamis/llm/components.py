"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.shared import stash


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) but the roots themselves; root is its component's smallest node.

    Alternating large and small stars (Kiveris et al. 2014): each node's larger
    neighbours, then its smaller ones, are linked to the smallest in its
    neighbourhood, until all edges are stars, in about log(n) rounds. Every
    round is written to the shared folder, so no lineage grows, and nothing is
    gathered but one truth value.
    """
    edges = stash(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        met = _with_least(large)
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(met.select("a", F.col("m").alias("b")))
        edges = stash(small.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root has one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
    return odd.isEmpty()


def _with_least(pairs: DataFrame, salts: int = 16) -> DataFrame:
    """``pairs`` (a, b) with m, the smallest b of each a; the many pairs of a hub are dealt out by salt."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("a", "salt").join(least, "a"), ["a", "salt"]).drop("salt")
