"""Connected components of a link table as repeated joins, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.inline(ends))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link down at most, and none that has one is linked from above."""
    up, down = F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.inline(F.array(up, down))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over links (a, b).

    Alternates large-star and small-star steps until all links are stars around
    the smallest node; each step is an aggregate and a join of at most the link
    count. A node with many neighbours only sends its minimum out, so a hot node
    is split like any other skewed join. No links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(edges.distinct(), "links")
    while not _settled(edges):
        both = _both_ways(edges)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        down = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = small.unionByName(least.select("a", F.col("low").alias("b")))
        edges = staged(after.distinct(), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots), "components")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """components of the links behind comp and further ones: only the classes that these connect are looked at."""
    between = links.select("a", "b").join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    up = components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    known = comp.join(up.toDF("comp", "_up"), "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp"))
    return staged(known.unionByName(up.join(comp.select("node"), "node", "left_anti")), "components")
