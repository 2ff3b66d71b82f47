"""What the similarity joins share: cores of like items, whose pairs are counted in blocks, and classes with numbers of links.

Items are named by ``doc_id``. A core is a connected set of items that are known to be similar; it decides
only where a pair is looked at: within cores all pairs are counted, between cores candidates are searched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .graph import components


#: Items that may have the same other end of their pairs.
STAR = 1000


def spread(column: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(column), n).cast("int")


def tiles(parts: str, part: str) -> Column:
    """An array of the tiles (row, col) with row <= col that a part takes part in."""
    return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda i: F.struct(F.least(i, F.col(part)).alias("row"), F.greatest(i, F.col(part)).alias("col")))


def leaders(sketches: DataFrame) -> DataFrame:
    """(a, b) of sketches (doc_id, keys): b is the least item that agrees with a in one of its keys.

    Where more than STAR items agree they are cut into parts; an item meets the least of its part, and that the least of all,
    so that no item is the other end of very many pairs.
    """
    keys = sketches.select("doc_id", F.posexplode("keys").alias("k", "key"))
    first = keys.groupBy("k", "key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    with_first = keys.join(first, ["k", "key"])
    large = with_first.where(F.col("n") > STAR).withColumn("part", spread("doc_id", F.ceil(F.col("n") / STAR)))
    heads = large.groupBy("k", "key", "part").agg(F.min("doc_id").alias("head"), F.first("b").alias("b"))
    pairs = with_first.where(F.col("n") <= STAR).select(F.col("doc_id").alias("a"), "b").unionAll(large.drop("b").join(heads, ["k", "key", "part"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    return keep(pairs.unionAll(heads.select(F.col("head").alias("a"), "b")).where("a <> b").distinct())


def cores(similar: DataFrame) -> DataFrame:
    """(doc_id, core) of the items in similar pairs (a, b)."""
    return components(similar).select(F.col("node").alias("doc_id"), F.col("component").alias("core"))


def placed(items: DataFrame, core: DataFrame, mass: str, most: int) -> DataFrame:
    """The items of cores with core, part, row, col and grp, by which they are to be grouped.

    A core whose mass is at most ``most`` shares a group with others; a larger one is cut into parts, and
    each group holds two of them (or one by itself, where row equals col).
    """
    held = keep(items.select("doc_id", mass).join(core, "doc_id").groupBy("core").agg(F.sum(mass).alias("mass")))
    total = held.agg(F.sum("mass")).first()[0] or 0
    held = held.select("core", F.ceil(F.col("mass") / most).cast("int").alias("parts"), spread("core", F.lit(max(1, math.ceil(total / most)))).alias("bucket"))
    out = items.join(core.join(held, "core"), "doc_id").withColumn("part", spread("doc_id", F.col("parts"))).withColumn("tile", F.explode(tiles("parts", "part")))
    grp = F.when(F.col("parts") == 1, F.struct(F.lit(-1).cast("long").alias("core"), F.col("bucket").alias("row"), F.lit(0).alias("col"))).otherwise(F.struct("core", "tile.row", "tile.col"))
    return out.withColumn("grp", grp).withColumn("row", F.col("tile.row")).withColumn("col", F.col("tile.col")).drop("tile", "parts", "bucket")


def classified(everyone: DataFrame, items: DataFrame, copies: DataFrame, core: DataFrame, within: DataFrame, across: DataFrame) -> DataFrame:
    """(doc_id, class_id, links) of everyone.

    items: those compared; copies (doc_id, rep): those that an item stands for; within (doc_id, links): of
    pairs within a core; across (a, b): similar pairs of different cores.
    """
    ends = across.select(F.col("a").alias("doc_id")).unionAll(across.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("links"))
    links = within.unionAll(ends).groupBy("doc_id").agg(F.sum("links").alias("links"))
    named = lambda x: core.select(F.col("doc_id").alias(x), F.col("core").alias(f"c{x}"))
    crossed = across.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(crossed).withColumnRenamed("node", "core").withColumnRenamed("component", "joined")
    found = items.select("doc_id").join(core, "doc_id", "left").withColumn("core", F.coalesce("core", "doc_id")).join(joined, "core", "left").select("doc_id", F.coalesce("joined", "core").alias("class_id"))
    found = found.join(links, "doc_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links")).where("class_id <> doc_id or links > 0")
    also = found.join(copies.withColumnRenamed("doc_id", "copy"), F.col("doc_id") == F.col("rep"), "right").select(F.col("copy").alias("doc_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    found = keep(found.unionAll(also))
    return everyone.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
