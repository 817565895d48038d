"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.lineage import cut


def _large(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node of a component but its least one, and that least one.

    ``edges`` has columns u and v; loops and repeats are ignored. Each pass reads and writes a table of at most as many
    links; hot nodes are reduced before the shuffle and the join back can be split.
    """
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = cut(_small(_large(edges)))
    return edges
