"""The engine: scripts of the dialect in, DataFrames out."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AlreadyExists, EngineError, Invalid, NotFound, SyntaxProblem
from .functions.types import BAD_VALUE, SqlType, from_text
from .operators import layouts, spatial, vision
from .operators.text import Analyzer, TextIndex
from .plans import ast as A
from .plans import predicates
from .plans.parser import parse
from .sources.catalog import Catalog, Index, Table
from .sources.storage import RID, Storage, last_of_each, read_csv


class Engine:
    """Tables live under root, which all executors must be able to reach.

    extract: from the bytes of an image file to its descriptors. analyzers: by name (the first word among a spimi index's params that is
    one) how texts become terms; English and Spanish are known.
    """

    def __init__(self, spark: SparkSession, root: str, extract: Callable[[bytes], np.ndarray] = vision.describe_pixels, analyzers: dict[str, Analyzer] | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.storage = Storage(spark, self.catalog)
        self.extract = extract
        self.analyzers = {"english": Analyzer("english"), "spanish": Analyzer("spanish"), **(analyzers or {})}

    # -- entry points

    def sql(self, script: str) -> DataFrame | None:
        """Run all statements of a script; the result of the last one."""
        return self._all(parse(script))

    def _all(self, statements: list) -> DataFrame | None:
        result = None
        for statement in statements:
            result = getattr(self, f"_{type(statement).__name__.lower()}")(statement)
        return result

    def run(self, script: str) -> dict:
        """The last result in the form that a service returns.

        Errors have status 400: of syntax with what was expected and where, of statements, and of Spark while it ran one. Anything else has 500.
        """
        begun = time.time_ns()
        try:
            statements = parse(script)
            df = self._all(statements)
            rows = [json.loads(r) for r in df.toJSON().toLocalIterator()] if df is not None else []
        except SyntaxProblem as e:
            return {"status": 400, "message": str(e), "expected": list(e.expected), "at": e.at}
        except EngineError as e:
            return {"status": 400, "message": str(e)}
        except PySparkException as e:
            return {"status": 400, "message": str(e).split("\n")[0]}
        except Exception as e:  # a service answers whatever happens
            return {"status": 500, "message": f"{type(e).__name__}: {e}"}
        kinds = dict(df.dtypes) if df is not None else {}
        last = statements[-1]
        return {
            "status": 200, "table": last.table, "columns": list(kinds), "columns_types": list(kinds.values()), "data": [[r.get(c) for c in kinds] for r in rows],
            "message": f"{type(last).__name__.lower()} took {(time.time_ns() - begun) / 1e6:.3f} ms",
        }

    def attach(self, name: str, rows: DataFrame, key: str) -> None:
        """Take a DataFrame for a table of this session that can be read and indexed, but not changed. The key, a whole number, stands for the row's position."""
        kinds = {"bigint": "long", "string": "text", "timestamp_ntz": "timestamp", "boolean": "bool", "decimal(20,0)": "ulong"}
        columns = tuple((c, kinds.get(k, k)) for c, k in rows.dtypes if kinds.get(k, k) in ("int", "long", "ulong", "float", "double", "text", "timestamp", "bool", "date"))
        if self.catalog.exists(name):
            raise AlreadyExists(f"table {name} exists")
        if key not in dict(columns):
            raise NotFound(f"no column {key} in {name}")
        self.storage.attached[name] = rows.select(*(c for c, _ in columns))
        self.catalog.attached[name] = Table(name, columns, key, tuple(Index("spimi", (c,)) for c, k in columns if k == "text"), parts=("attached",))

    def upload(self, name: str, content: bytes) -> str:
        """Store a file; the path under which COPY and ``<->`` find it."""
        if not name or "/" in name or name.startswith("."):
            raise Invalid(f"no name of a file: {name!r}")
        path = f"{self.catalog.root}/_files/{name}"
        self.catalog.files.write(path, content)
        return path

    def fetch(self, table: str, positions: Sequence[int]) -> DataFrame:
        """(_rid, columns): the live rows at some positions, which ``positions`` tells."""
        return self.storage.fetch(self.catalog.get(table), positions)

    def positions(self, table: str) -> DataFrame:
        """(_rid, key) of the live rows."""
        t = self.catalog.get(table)
        return self.storage.scan(t).select(RID, t.key)

    def load_collection(self, table: str, path: str, encoding: str = "ISO-8859-1") -> int:
        """Append a CSV file of texts; of rows that repeat the primary key the last one counts. The number of rows appended."""
        t = self.catalog.get(table)
        rows = read_csv(self.spark, path, t.types, encoding=encoding).withColumn("_at", F.monotonically_increasing_id())
        now = self._appended(t, last_of_each(rows, t.key, "_at").select(*t.types))
        return now.rows - t.rows

    def info(self) -> DataFrame:
        return self.catalog.info()

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        t = self.catalog.get(name)
        return self.storage.scan(t).select(*t.types)

    def indexes(self, name: str) -> DataFrame:
        """(kind, columns, built, files, bytes, rows_behind): the state of a table's indexes."""
        t, rows = self.catalog.get(name), []
        for i in t.indexes:
            files = size = 0
            if i.layout:
                parts = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(i.layout)
                files, size = parts.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            behind = self.storage.read(t, t.parts[i.parts :]).count()
            rows.append((i.kind, ",".join(i.columns), i.layout is not None, files, size, behind))
        return self.spark.createDataFrame(rows, "kind string, columns string, built boolean, files long, bytes long, rows_behind long")

    def dump(self, name: str, *columns: str) -> DataFrame:
        """What each file of an index holds: its rows and the range of each of the index's columns; of a text index the terms with their df."""
        index = self.catalog.get(name).index_on(*columns)
        if index is None or index.layout is None:
            raise NotFound(f"no index over {', '.join(columns)} is built")
        if index.kind == "spimi":
            return self.spark.read.parquet(f"{index.layout}/df")
        return layouts.dump(self.spark.read.parquet(index.layout), columns)

    # -- images

    def register_descriptors(self, table: str, column: str, descriptors: DataFrame, codebook: list[list[float]]) -> None:
        """Store descriptors (name, descriptors) of the files that a file column names, as histograms of the codebook's words, for ``<->`` searches."""
        path = self._images(table, column)
        self.catalog.files.delete(path)
        self.catalog.files.write(f"{path}/codebook.json", json.dumps([list(map(float, c)) for c in codebook]))
        self.add_descriptors(table, column, descriptors)

    def add_descriptors(self, table: str, column: str, descriptors: DataFrame) -> None:
        """Add images to those stored."""
        named = descriptors.select(F.col(descriptors.columns[0]).cast("string").alias("name"), F.col(descriptors.columns[1]).alias("descriptors"))
        vision.histogram(named, self._codebook(table, column), "name").write.mode("append").parquet(f"{self._images(table, column)}/words")

    def index_images(self, table: str, column: str, words: int = 1000) -> None:
        """Describe the files that a file column names, fit a codebook to all of their descriptors, and store their histograms."""
        found = vision.describe(self._contents(self.table(table).select(F.col(column).alias("path")).where("path is not null")), self.extract, "path")
        self.register_descriptors(table, column, found, vision.vocabulary(found, words))

    def add_image(self, table: str, column: str, path: str) -> None:
        """Describe one more file with the stored codebook."""
        self.add_descriptors(table, column, self._described(path))

    def image_words(self, table: str, column: str, name: str | None = None) -> DataFrame:
        """(name, word, n): the stored histograms, or that of one image."""
        if not self.catalog.files.exists(f"{self._images(table, column)}/words"):
            raise Invalid(f"no descriptors for {table}.{column}")
        words = self.spark.read.parquet(f"{self._images(table, column)}/words")
        return words if name is None else words.where(F.col("name") == F.lit(name))

    def _images(self, table: str, column: str) -> str:
        t = self.catalog.get(table)
        self._columns(t, (column,))
        return f"{self.catalog.folder(table)}/_images-{column}"

    def _codebook(self, table: str, column: str) -> list[list[float]]:
        path = f"{self._images(table, column)}/codebook.json"
        if not self.catalog.files.exists(path):
            raise Invalid(f"no descriptors for {table}.{column}")
        return json.loads(self.catalog.files.read(path))

    def _contents(self, paths: DataFrame) -> DataFrame:
        """(path, content) of files. Each is opened by the executor that describes it."""
        files = self.spark.read.format("binaryFile").load([r.path for r in paths.distinct().toLocalIterator()])
        return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")

    def _described(self, path: str) -> DataFrame:
        if not self.catalog.files.exists(path):
            raise NotFound(f"no file {path}")
        return vision.describe(self.spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), "content"), self.extract, "path")

    # -- definitions

    def _createtable(self, s: A.CreateTable) -> DataFrame:
        if self.catalog.exists(s.table):
            raise AlreadyExists(f"table {s.table} exists")
        names = [c.name for c in s.columns]
        if len(set(names)) != len(names):
            raise Invalid("a column is named twice")
        keys = [c.name for c in s.columns if c.primary_key]
        if len(keys) != 1:
            raise Invalid("a table needs exactly one primary key column")
        for c in s.columns:
            SqlType.parse(c.type)
        indexes = tuple(Index(c.index or ("spimi" if c.type == "text" else "bptree"), (c.name,), c.params) for c in s.columns if c.index or c.primary_key or c.type == "text")
        table = self.catalog.create(Table(s.table, tuple((c.name, c.type) for c in s.columns), keys[0], indexes))
        kinds = {i.columns[0]: i.kind for i in table.indexes}
        return self.spark.createDataFrame([(c.name, c.type, kinds.get(c.name)) for c in s.columns], "column string, type string, index string")

    def _droptable(self, s: A.DropTable) -> DataFrame:
        self.catalog.drop(s.table)
        self.storage.attached.pop(s.table, None)
        return self._said(f"table {s.table} dropped")

    def _createindex(self, s: A.CreateIndex) -> DataFrame:
        t = self.catalog.get(s.table)
        self._columns(t, s.columns)
        if s.kind != "rtree" and len(s.columns) != 1:
            raise Invalid(f"a {s.kind} index has one column")
        if s.kind == "rtree" and any(i.kind == "rtree" for i in t.indexes):
            raise AlreadyExists(f"table {s.table} has an rtree index")
        if t.index_on(*s.columns):
            raise AlreadyExists(f"{', '.join(s.columns)} has an index")
        self._built(t, Index(s.kind, s.columns, s.params))
        return self._said(f"index {s.kind} created")

    def _dropindex(self, s: A.DropIndex) -> DataFrame:
        t = self.catalog.get(s.table)
        index = next((i for i in t.indexes if i.kind == s.kind and i.columns == s.columns), None)
        if index is None:
            raise NotFound(f"no {s.kind} index on {', '.join(s.columns)}")
        self.catalog.update(t.name, lambda now: replace(now, indexes=tuple(i for i in now.indexes if (i.kind, i.columns) != (index.kind, index.columns))))
        if index.layout:
            self.catalog.files.delete(index.layout)
        return self._said(f"index {s.kind} dropped")

    # -- changes

    def _insert(self, s: A.Insert) -> DataFrame:
        t = self.catalog.get(s.table)
        self._columns(t, s.columns)
        if len(s.columns) != len(s.values) or len(set(s.columns)) != len(s.columns):
            raise Invalid(f"{len(s.columns)} columns, {len(s.values)} values")
        missing = [c for c, kind in t.types.items() if c not in s.columns and kind.name != "timestamp"]
        if missing:
            raise Invalid(f"no value for {', '.join(missing)}")
        given = dict(zip(s.columns, s.values))
        row = self.spark.range(1).select(*(from_text(F.lit(given[c]), k).alias(c) if c in given else F.current_timestamp().cast(k.spark).alias(c) for c, k in t.types.items()))
        bad = [c for c, v in row.first().asDict().items() if v is None]
        if bad:
            raise Invalid(f"no {t.types[bad[0]]}: {given[bad[0]]!r}")
        t = self.storage.append(t, row)
        if self.storage.worn(t):
            self.compact(s.table)
        return self._said("1 row inserted")

    def _copy(self, s: A.Copy) -> DataFrame:
        t = self.catalog.get(s.table)
        if not self.catalog.files.exists(s.path):
            raise NotFound(f"no file {s.path}")
        before = t.rows
        t = self._appended(t, read_csv(self.spark, s.path, t.types, s.limit))
        copied = t.rows - before
        for index in t.indexes:
            t = self._built(t, index)
        return self._said(f"{copied} rows copied")

    def _appended(self, t: Table, rows: DataFrame) -> Table:
        """Append rows; a value that its column can't hold is an error, and nothing is appended then."""
        try:
            return self.storage.append(t, rows)
        except PySparkException as e:
            if BAD_VALUE in str(e):
                raise Invalid(str(e)[str(e).index(BAD_VALUE) :].split("\n")[0].split(" SQLSTATE")[0]) from None
            raise

    def append(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Append a DataFrame; its columns are matched by name. batch: see ``Storage.append``."""
        self.storage.append(self.catalog.get(table), rows, batch)

    def _delete(self, s: A.Delete) -> DataFrame:
        t = self.catalog.get(s.table)
        self._columns(t, predicates.used_columns(s.where))
        t, n = self.storage.bury(t, self._filtered(t, s.where)[0])
        if self.storage.worn(t):
            self.compact(s.table)
        return self._said(f"{n} rows deleted")

    def compact(self, table: str) -> None:
        """Rewrite the live rows and build the indexes anew."""
        t = self.storage.compact(self.catalog.get(table))
        for index in t.indexes:
            t = self._built(t, index)

    # -- indexes

    def _built(self, t: Table, index: Index) -> Table:
        """The table with the index built over its live rows; the old layout goes once the new one is in the catalog."""
        old = index.layout
        path = f"{self.catalog.folder(t.name)}/{index.kind}-{uuid.uuid4().hex}"
        n = t.rows - t.dead if t.name not in self.catalog.attached else self.storage.scan(t).count()
        if index.kind == "spimi":
            # with an index over the first parts only the rows of the others are read as text
            rows = self.storage.alive(t, self.storage.read(t, t.parts[index.parts :])) if old else self.storage.scan(t)
            held = TextIndex.write(path, rows, RID, index.columns[0], self._analyzer(index), old, self.storage.graves(t)) if n else None
            mark = f"{t.snapshot}.{len(t.parts)}.{t.dead}.{held.n if held else 0}"
        else:
            mark = str(layouts.build(self.storage.scan(t), index.kind, index.columns, path, n, self._params(index))) if n else "0"
        new = replace(index, layout=path if n else None, parts=len(t.parts) if n else 0, params=(*self._params(index), f"~{mark}"))
        # if the table was compacted meanwhile, the layout's parts are no more
        now = self.catalog.update(t.name, lambda x: x.with_index(new) if x.snapshot == t.snapshot else x)
        if old:
            self.catalog.files.delete(old)
        return now

    @staticmethod
    def _mark(index: Index) -> str:
        return next((p[1:] for p in index.params if p.startswith("~")), "")

    @staticmethod
    def _params(index: Index) -> tuple[str, ...]:
        return tuple(p for p in index.params if not p.startswith("~"))

    def _analyzer(self, index: Index) -> Analyzer:
        return next((self.analyzers[p] for p in index.params if p in self.analyzers), Analyzer())

    def _rows(self, t: Table, where: object) -> DataFrame:
        """Live rows among which those that meet the condition are, read through an index where one fits."""
        for e in predicates.conjuncts(where):
            columns = e.columns if hasattr(e, "columns") else (e.column,) if hasattr(e, "column") else ()
            index = t.index_on(*columns)
            if index is None or index.layout is None or index.kind == "spimi":
                continue
            if index.kind == "hash" and not (isinstance(e, A.Compare) and e.op == "=="):
                continue
            if isinstance(e, (A.Closest, A.TextMatch, A.ImageMatch)) or isinstance(e, A.Compare) and e.op == "!=":
                continue
            rows = self.spark.read.parquet(index.layout)
            if index.kind == "hash":
                kind = t.types[e.column].spark
                rows = rows.where(F.col(layouts.BUCKET) == layouts.bucket_of(F.lit(e.value).cast(kind), int(self._mark(index)))).drop(layouts.BUCKET)
            rows = rows.select(RID, *t.types)
            late = t.parts[index.parts :]
            return self.storage.alive(t, rows.unionByName(self.storage.read(t, late)) if late else rows)
        return self.storage.scan(t)

    # -- queries

    def _select(self, s: A.Select) -> DataFrame:
        t = self.catalog.get(s.table)
        names = self._columns(t, s.columns) or tuple(t.types)
        self._columns(t, predicates.used_columns(s.where))
        rows, order = self._filtered(t, s.where)
        if order:
            rows = rows.orderBy(*order)
        out = rows.select(*(F.col(c) for c in names))
        return out if s.limit is None else out.limit(s.limit)

    def _filtered(self, t: Table, where: object) -> tuple[DataFrame, list]:
        """(the rows that meet a condition, and what orders them: the last ranking in it, then the key)."""
        if where is None:
            return self.storage.scan(t), []
        rows, order = self._rows(t, where), []
        needed = predicates.conjuncts(where)
        stands: dict[int, Column] = {}
        for i, e in enumerate(e for e in A.leaves(where) if isinstance(e, A.RANKED)):
            if isinstance(e, A.Radius):
                point = predicates.numbers(e.point)
                away = predicates.distance(e.columns, point)
                low, high = tuple(v - e.r for v in point), tuple(v + e.r for v in point)
                stands[id(e)] = predicates.box(e.columns, low, high) & (away < e.r)
                order = [F.when(stands[id(e)], away).asc_nulls_last(), F.col(t.key)]
                continue
            found = self._ranking(t, e).withColumnRenamed(RID, f"_r{i}")
            rows = rows.join(found, F.col(RID) == F.col(f"_r{i}"), "inner" if e in needed else "left").withColumnRenamed("_by", f"_by{i}")
            stands[id(e)] = F.col(f"_r{i}").isNotNull()
            order = [F.col(f"_by{i}").asc_nulls_last(), F.col(t.key)]
        return rows.where(predicates.column(where, t.types, lambda e: stands[id(e)])), order

    def _ranking(self, t: Table, e: object) -> DataFrame:
        """(row id, _by) of the k best of the whole table, the least _by first."""
        if isinstance(e, A.Closest):
            near = spatial.closest(self.storage.scan(t), e.columns, predicates.numbers(e.point), e.k, t.key)
            return near.select(RID, F.col(spatial.DIST).alias("_by"))
        if isinstance(e, A.ImageMatch):
            words = self.image_words(t.name, e.column)
            if self.image_words(t.name, e.column, e.file).isEmpty():  # a new image
                best = vision.nearest_to(words, "name", vision.histogram(self._described(e.file), self._codebook(t.name, e.column), "path"), e.k)
            else:
                best = vision.nearest(vision.tf_idf(words, "name"), "name", e.file, e.k)
            return self.storage.scan(t).join(best, F.col(e.column) == F.col("name")).select(RID, (-F.round("score", 12)).alias("_by"))
        index = t.index_on(e.column)
        if index is not None and index.kind == "spimi":
            if not self._mark(index).startswith(f"{t.snapshot}.{len(t.parts)}.{t.dead}."):  # rows came or went since
                t = self._built(t, index)
                index = t.index_on(e.column)
            if index.layout is None:
                return self.spark.createDataFrame([], f"{RID} long, _by double")
            held = TextIndex.read(self.spark, index.layout, RID, int(self._mark(index).split(".")[3]), self._analyzer(index))
        else:
            held = TextIndex.build(self.storage.scan(t), RID, e.column)
        # scores that differ only by rounding are tied; ties go by the table's key, here at the cut and later in the order
        scored = held.scores(e.text).select(RID, (-F.round("score", 12)).alias("_by"))
        if t.name not in self.catalog.attached:  # there the row id is the key
            scored = scored.join(self.storage.scan(t).select(RID, F.col(t.key).alias("_key")), RID)
        return scored.orderBy("_by", *scored.columns[2:], RID).limit(e.k).select(RID, "_by")

    # -- helpers

    def _columns(self, t: Table, names: tuple[str, ...] | list[str]) -> tuple[str, ...]:
        for c in names:
            if c not in t.types:
                raise NotFound(f"no column {c} in {t.name}")
        return tuple(names)

    def _said(self, message: str) -> DataFrame:
        return self.spark.createDataFrame([(message,)], "message string")
