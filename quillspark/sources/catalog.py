"""Catalog: declared columns, primary key, indexes and the current snapshot of each table.

Each change writes a new numbered description; the highest one holds. A description appears
whole and never replaces another, so a writer that is lost midway leaves the table as it was, and of two
writers that start from the same one the second finds its number taken and applies its change to what the first left.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import AlreadyExists, NotFound
from ..functions.types import SqlType
from .files import Files


@dataclass(frozen=True)
class Index:
    kind: str
    columns: tuple[str, ...]
    params: tuple[str, ...] = ()
    layout: str | None = None  # folder of the derived table; None: not built yet
    parts: int = 0  # how many of the table's parts, from the first, it holds


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[tuple[str, str], ...]
    key: str
    indexes: tuple[Index, ...] = ()
    snapshot: int = 0
    next_rid: int = 0
    rows: int = 0  # ever appended to this snapshot
    dead: int = 0
    parts: tuple[str, ...] = field(default=())  # folders that hold the rows
    graves: tuple[str, ...] = field(default=())  # folders of deleted row ids
    batches: tuple[tuple[str, int], ...] = field(default=())  # the last micro-batch of each stream that has been appended

    @property
    def types(self) -> dict[str, SqlType]:
        return {c: SqlType.parse(t) for c, t in self.columns}

    def index_on(self, *columns: str) -> Index | None:
        return next((i for i in self.indexes if i.columns == columns), None)

    def with_index(self, index: Index) -> Table:
        others = tuple(i for i in self.indexes if (i.kind, i.columns) != (index.kind, index.columns))
        return replace(self, indexes=(*others, index))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.attached: dict[str, Table] = {}  # tables of this session only

    def folder(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _versions(self, table: str) -> list[str]:
        return [n for n in self.files.names(f"{self.folder(table)}/_catalog") if n.endswith(".json") and not n.startswith(".")]

    def exists(self, table: str) -> bool:
        return table in self.attached or bool(self._versions(table))

    def get(self, table: str) -> Table:
        return self._at(table)[1]

    def _at(self, table: str) -> tuple[int, Table]:
        """The number of the description that holds, and the table."""
        if table in self.attached:
            return 0, self.attached[table]
        for name in reversed(self._versions(table)):
            d = json.loads(self.files.read(f"{self.folder(table)}/_catalog/{name}"))
            d["indexes"] = tuple(Index(i["kind"], tuple(i["columns"]), tuple(i["params"]), i["layout"], i["parts"]) for i in d["indexes"])
            return int(name.split(".")[0]), Table(**{k: tuple(map(tuple, v)) if k in ("columns", "batches") else tuple(v) if k in ("parts", "graves") else v for k, v in d.items()})
        raise NotFound(f"no table {table}")

    def update(self, table: str, change: Callable[[Table], Table]) -> Table:
        """Apply a change to the table as it is now; again, if another writer was faster."""
        while True:
            number, now = self._at(table)
            after = change(now)
            if after == now:
                return now
            if table in self.attached:
                self.attached[table] = after
                return after
            if self._write(after, number + 1):
                # the one before stays for readers that have just listed it
                for old in self._versions(table)[:-2]:
                    self.files.delete(f"{self.folder(table)}/_catalog/{old}")
                return after

    def _write(self, table: Table, number: int) -> bool:
        return self.files.write_new(f"{self.folder(table.name)}/_catalog/{number:012d}.json", json.dumps(asdict(table)))

    def create(self, table: Table) -> Table:
        if self.exists(table.name) or not self._write(table, 0):
            raise AlreadyExists(f"table {table.name} exists")
        return table

    def drop(self, table: str) -> None:
        self.get(table)
        self.attached.pop(table, None)
        self.files.delete(self.folder(table))

    def tables(self) -> list[str]:
        return sorted({*self.attached, *(n for n in self.files.names(self.root) if self.exists(n))})

    def info(self) -> DataFrame:
        """(table, column, type, primary_key, index), a row for each column."""
        rows = []
        for t in map(self.get, self.tables()):
            for c, kind in t.columns:
                rows.append((t.name, c, kind, c == t.key, ",".join(sorted(i.kind for i in t.indexes if c in i.columns)) or None))
        return self.spark.createDataFrame(rows, "table string, column string, type string, primary_key boolean, index string")
