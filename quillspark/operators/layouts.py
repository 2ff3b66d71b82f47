"""Physical layouts that stand for index structures. They change what a scan reads, never what it returns.

hash            folders by hash bucket of the column; equality reads one of them
bptree seq isam range-partitioned and sorted files; footer statistics prune them
brin            rows in arrival order with small row groups; min and max of each prune
rtree           files along a Z-order curve of the coordinates; boxes prune by statistics
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut_lineage
from .spatial import z_value

BUCKET = "_bucket"
ROWS_PER_FILE = 2_000_000
ROWS_PER_BUCKET = 500_000
MOST_BUCKETS = 4096


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def build(rows: DataFrame, kind: str, columns: Sequence[str], path: str, n: int, params: Sequence[str] = ()) -> int:
    """Write the layout of n rows; returns the number of hash buckets (0 for other kinds).

    The first whole number among params is the number of buckets of a hash layout, and the most rows of a file of the others.
    """
    given = next((int(p) for p in params if p.isdigit() and int(p)), None)
    files = max(1, -(-n // (given or ROWS_PER_FILE)))
    if kind == "hash":
        # beyond so many buckets they grow instead, and are sorted, so that statistics prune within them
        buckets = min(MOST_BUCKETS, given or max(8, -(-n // ROWS_PER_BUCKET)))
        sorted_rows = rows.withColumn(BUCKET, bucket_of(F.col(columns[0]), buckets)).repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, columns[0])
        sorted_rows.write.option("parquet.block.size", 16 << 20).partitionBy(BUCKET).parquet(path)
        return buckets
    if kind == "brin":
        rows.write.options(**{"parquet.block.size": 8 << 20, "maxRecordsPerFile": given or 0}).parquet(path)
    elif kind == "rtree":
        edges = rows.agg(*(f(c).cast("double") for c in columns for f in (F.min, F.max))).first()
        low, high = [e or 0.0 for e in edges[::2]], [e or 0.0 for e in edges[1::2]]
        rows.withColumn("_z", z_value(columns, low, high)).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.option("parquet.block.size", 8 << 20).parquet(path)
    else:
        rows.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.option("parquet.block.size", 16 << 20).parquet(path)
    return 0


def dump(layout: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(file, n, lo_c, hi_c for each column c): what each file of a layout holds."""
    edges = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return layout.groupBy(F.regexp_extract(F.input_file_name(), r"[^/]+(/[^/]*)?$", 0).alias("file")).agg(F.count("*").alias("n"), *edges)


def zone_map(rows: DataFrame, column: str, order: str, block: int = 1200) -> DataFrame:
    """(block, n, lo, hi) of the blocks of consecutive rows by a dense whole-number order column."""
    return rows.groupBy(F.floor(F.col(order) / block).cast("long").alias("block")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))


def through_zone_map(rows: DataFrame, zones: DataFrame, column: str, order: str, low: object, high: object, block: int = 1200) -> DataFrame:
    """Rows with a column in [low, high]: only blocks whose range meets it are looked at."""
    hit = zones.where((F.col("hi") >= F.lit(low)) & (F.col("lo") <= F.lit(high))).select("block")
    return rows.withColumn("block", F.floor(F.col(order) / block).cast("long")).join(hit, "block", "left_semi").where(F.col(column).between(F.lit(low), F.lit(high))).drop("block")


def numbered(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Ordered rows with their place in the order, from 1.

    The rows of each partition are counted by themselves and offsets of the partitions
    are added, so no single task sees all rows.
    """
    # the checkpoint fixes the partitions that the two uses below must agree on
    held = cut_lineage(ordered).withColumn("_part", F.spark_partition_id())
    # the lower 33 bits count the rows of the partition, which are in order already
    inner = held.withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = held.groupBy("_part").count()
    # one row for each partition
    before = sizes.withColumn("_base", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    return inner.join(F.broadcast(before), "_part").withColumn(name, (F.col("_n") + F.col("_base")).cast("long")).drop("_part", "_n", "_base")


def in_order(rows: DataFrame, columns: Sequence[str], tie: str) -> DataFrame:
    """Rows with their position (from 1) in the order of columns, then tie."""
    return numbered(rows.repartitionByRange(*columns, tie).sortWithinPartitions(*columns, tie))
