"""Connected components of a link table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.session import written


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("hi <> lo").distinct()


def components(links: DataFrame) -> DataFrame:
    """(``a``, ``b``) links to (``node``, ``root``), root being the least node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links are stars around their
    least node, which takes few rounds whatever the components' diameters. Each step replaces a node's links by
    links to its least neighbour. The least neighbours are written down before they are joined to the links, so
    that both sides of the join are plain tables and Spark can split a hub's partition. Roots are not listed.
    Empty links give an empty table.
    """
    edges = written(
        _distinct(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    )
    before = None
    while (now := edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()) != before:
        before = now
        edges = written(_small_star(written(_large_star(edges))))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = written(around.groupBy("u").agg(F.min(F.least("u", "v")).alias("least")))
    return _distinct(
        around.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("least").alias("lo"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = written(edges.groupBy("hi").agg(F.min("lo").alias("least")))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return _distinct(moved.union(least))
