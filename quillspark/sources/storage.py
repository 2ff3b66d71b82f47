"""Rows of tables: append, delete by tombstones, compaction, reading live rows, and CSV and image files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..functions.types import SqlType, strict
from .catalog import Catalog, Table

RID = "_rid"
#: A table is compacted when this many rows, and this share of them, are deleted.
COMPACT_ROWS, COMPACT_SHARE = 30, 0.1
#: Parts beyond which small ones are merged.
MOST_PARTS = 64


def schema(table: Table) -> T.StructType:
    return T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(c, t.spark) for c, t in table.types.items())])


class Storage:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog
        self.attached: dict[str, DataFrame] = {}

    def _fresh(self, table: Table, sort: str) -> str:
        return f"{self.catalog.folder(table.name)}/{sort}-{uuid.uuid4().hex}"

    def read(self, table: Table, parts: tuple[str, ...] | None = None) -> DataFrame:
        if table.name in self.attached:
            rows = self.attached[table.name] if parts is None or parts else self.attached[table.name].where("false")
            return rows.select(F.col(table.key).cast("long").alias(RID), *table.types)
        parts = table.parts if parts is None else parts
        return self.spark.read.schema(schema(table)).parquet(*parts) if parts else self.spark.createDataFrame([], schema(table))

    def graves(self, table: Table) -> DataFrame | None:
        return self.spark.read.schema(f"{RID} long").parquet(*table.graves) if table.graves else None

    def alive(self, table: Table, rows: DataFrame) -> DataFrame:
        dead = self.graves(table)
        return rows if dead is None else rows.join(dead, RID, "left_anti")

    def scan(self, table: Table) -> DataFrame:
        """The live rows with their row ids."""
        return self.alive(table, self.read(table))

    def fetch(self, table: Table, positions: Sequence[int]) -> DataFrame:
        """The live rows of some row ids; the ids reach the scan as a filter."""
        return self.alive(table, self.read(table).where(F.col(RID).isin([int(p) for p in positions])))

    def append(self, table: Table, rows: DataFrame, batch: tuple[str, int] | None = None) -> Table:
        """Rows of the declared columns, written with row ids that grow in the order of the partitions.

        batch: the stream and the number of the micro-batch that the rows are; the number goes into the catalog by the
        same write that makes the rows visible, so a batch that comes again changes nothing.
        """
        if table.name in self.attached:
            raise Invalid(f"{table.name} is attached and can't be changed")
        seen = lambda t: batch is not None and dict(t.batches).get(batch[0], -1) >= batch[1]
        if seen(table):
            return table
        numbered = rows.select(*(F.col(c).cast(t.spark).alias(c) for c, t in table.types.items()))
        # ids are set aside before they are used, so that two writers never give the same
        room = max(1, numbered.rdd.getNumPartitions()) << 33
        first = self.catalog.update(table.name, lambda t: replace(t, next_rid=t.next_rid + room)).next_rid - room
        path = self._fresh(table, "rows")
        numbered.select((F.monotonically_increasing_id() + first).alias(RID), "*").write.parquet(path)
        n = self.spark.read.schema(schema(table)).parquet(path).count()

        def change(t: Table) -> Table:
            if seen(t):
                return t
            batches = tuple(sorted({**dict(t.batches), batch[0]: batch[1]}.items())) if batch else t.batches
            return replace(t, parts=(*t.parts, path), rows=t.rows + n, batches=batches) if n else replace(t, batches=batches)

        now = self.catalog.update(table.name, change)
        if path not in now.parts:
            self.catalog.files.delete(path)
        return now

    def bury(self, table: Table, hit: DataFrame) -> tuple[Table, int]:
        """Tombstones for rows of the given ids."""
        if table.name in self.attached:
            raise Invalid(f"{table.name} is attached and can't be changed")
        path = self._fresh(table, "graves")
        hit.select(RID).write.parquet(path)
        n = self.spark.read.schema(f"{RID} long").parquet(path).count()
        if not n:
            self.catalog.files.delete(path)
            return table, 0
        return self.catalog.update(table.name, lambda t: replace(t, graves=(*t.graves, path), dead=t.dead + n)), n

    def worn(self, table: Table) -> bool:
        return table.dead >= max(COMPACT_ROWS, COMPACT_SHARE * table.rows) or len(table.parts) > MOST_PARTS

    def compact(self, table: Table) -> Table:
        """Live rows go to a new folder with their ids; the pointer moves only when it is complete. Rows that others append or bury meanwhile stay as they are."""
        path = self._fresh(table, "rows")
        self.scan(table).write.parquet(path)
        n = self.spark.read.schema(schema(table)).parquet(path).count()
        old = {*table.parts, *table.graves, *(i.layout for i in table.indexes if i.layout)}

        def change(t: Table) -> Table:
            if not set(table.parts) <= set(t.parts):
                return t  # another writer compacted it
            parts, graves = tuple(p for p in t.parts if p not in old), tuple(g for g in t.graves if g not in old)
            return replace(t, parts=(path, *parts), graves=graves, rows=n + t.rows - table.rows, dead=t.dead - table.dead, snapshot=t.snapshot + 1, indexes=tuple(replace(i, layout=None, parts=0) for i in t.indexes))

        now = self.catalog.update(table.name, change)
        for folder in old if path in now.parts else [path]:
            self.catalog.files.delete(folder)
        return now


def read_csv(spark: SparkSession, path: str, types: dict[str, SqlType], limit: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file by position, its first line skipped; all values are read as text and cast to the declared types. A value that can't be fails the job that reads it; an empty one is null."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in types])
    rows = spark.read.schema(fields).csv(path, header=True, enforceSchema=True, encoding=encoding, multiLine=True, escape='"')
    rows = rows.select(*(strict(F.col(c), t).alias(c) for c, t in types.items()))
    return rows if limit is None else rows.limit(limit)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one by order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in others))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, content) of the jpg, jpeg and png files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).rlike(r"\.(jpe?g|png)$")).select("path", name.alias("name"), "length", "content")
