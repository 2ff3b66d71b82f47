"""Connected components by alternating large and small stars, entirely on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): m is the least b beside an a. A hub's rows are aggregated in part before they meet, and its join is one that AQE may split."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); a component is named after its least node.

    Every round writes the edges to the checkpoint folder; it ends when a round
    changes nothing, after a number of rounds in the order of the logarithm of the size.
    Edges of a null node and loops count for nothing; repeated edges count once; an empty
    table gives an empty result.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = keep(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large)
        ends = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(ends.unionAll(small.select("a", F.col("m").alias("b"))).distinct())
        if (then := mark(now)) == seen:
            break
        seen = then
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionAll(star.select(F.col("component").alias("node"), "component").distinct())
