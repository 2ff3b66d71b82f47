"""Ranked text retrieval over an inverted index: document frequencies, TF-IDF weights, cosine ranking."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import bag_of_words, bags_by_row, gathered, repeats, terms

#: Terms, those of the highest df, whose df goes to every executor; the df of all others are joined.
FREQUENT = 200_000
#: Postings that are weighed and sorted together.
_RUN = 1 << 21


def document_frequency(bag: DataFrame) -> DataFrame:
    return bag.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: int | Column, df: Column) -> Column:
    """log10(n / df); 0 where the term or the collection is empty."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when((df > 0) & (n > 0), F.log10(n / df)).otherwise(F.lit(0.0))


def weights(bag: DataFrame, df: DataFrame, n: int, key: str) -> DataFrame:
    """(key, term, w): log10(1 + tf) * idf."""
    return bag.join(df, "term").select(key, "term", (F.log10(1 + F.col("tf")) * idf(n, F.col("df"))).alias("w"))


def norms(weighted: DataFrame, key: str) -> DataFrame:
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def frequencies(bags: DataFrame) -> DataFrame:
    """``document_frequency`` of bags (key, terms, tfs); each batch sends its terms once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["term", "df"])

    return bags.select("terms").mapInArrow(work, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weighed(bags: DataFrame, df: DataFrame, n: int, key: str) -> DataFrame:
    """(key, term, w, norm) of bags (key, terms, tfs), a row for each document; postings come in runs that are sorted by term.

    Few terms make up most postings. The df of the ``FREQUENT`` most frequent ones is broadcast, so that only postings of rarer terms are
    shuffled, for their df; a document then is met by the df of its rare terms as one row, and its weights and norm are found where it is.
    """
    kind = bags.schema[key].dataType.simpleString()
    best = df.orderBy(F.desc("df")).limit(FREQUENT + 1).select("term", "df").collect()
    least = best[-1]["df"] if len(best) > FREQUENT else 0  # frequent is what has more: FREQUENT terms at most
    often = [(r["term"], r["df"]) for r in best if r["df"] > least]
    held = bags.sparkSession.sparkContext.broadcast((pa.array([t for t, _ in often], pa.string()), np.array([d for _, d in often], float)))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = batch.column(1).flatten(), pc.list_parent_indices(batch.column(1))
            other = pc.invert(pc.is_in(flat, value_set=held.value[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row.filter(other)), flat.filter(other)], names=[key, "term"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, many = held.value
        for whole in batches:
            ends, start = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _RUN, "right")))
                batch = whole.slice(start, stop - start)
                start = stop
                flat, row = batch.column(1).flatten(), pc.list_parent_indices(batch.column(1)).to_numpy()
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy()
                at = pc.fill_null(pc.index_in(words, value_set=often), -1).to_numpy()
                count = np.where(at >= 0, many[at] if len(many) else 0.0, 0.0)
                if (at < 0).any():
                    known, dfs = batch.column(3).flatten(), batch.column(4).flatten().to_numpy()
                    place = pc.index_in(words.filter(pa.array(at < 0)), value_set=known).to_numpy(zero_copy_only=False)
                    count[at < 0] = dfs[place.astype(np.int64)]
                w = np.log10(1 + batch.column(2).flatten().to_numpy()) * np.log10(n / count)[code]
                norm = np.sqrt(np.bincount(row, w * w, batch.num_rows))
                rank = np.empty(len(words), np.int32)
                rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.int32)
                order = np.argsort(rank[code], kind="stable")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[order])), words.take(pa.array(code[order])), pa.array(w[order]), pa.array(norm[row[order]])], names=[key, "term", "w", "norm"])

    if least:
        pairs = bags.select(key, "terms").mapInArrow(rare, f"`{key}` {kind}, term string")
        found = pairs.join(df.where(F.col("df") <= least), "term").groupBy(F.col(key).alias("_of")).agg(F.collect_list(F.struct("term", "df")).alias("r"))
        met = bags.join(found, F.col(key).eqNullSafe(F.col("_of")), "left").select(key, "terms", "tfs", F.col("r.term").alias("rare"), F.col("r.df").alias("dfs"))
    else:
        met = bags.select(key, "terms", "tfs", F.lit(None).cast("array<string>").alias("rare"), F.lit(None).cast("array<long>").alias("dfs"))
    return met.mapInArrow(work, f"`{key}` {kind}, term string, w double, norm double")


def postings(bag: DataFrame, term: str, key: str) -> DataFrame:
    """The documents that hold a term."""
    return bag.where(F.col("term") == term).select(key)


def without_term(bag: DataFrame, term: str) -> DataFrame:
    """The collection as if a term had never occurred."""
    return bag.where(F.col("term") != term)


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: plain, or by the stop words, lemmas and stems of a language."""

    language: str | None = None
    stop: tuple[str, ...] | None = None
    lemma: Callable[[Column], Column] | None = None

    def bag(self, rows: DataFrame, key: str, text: str, unique: bool = True) -> DataFrame:
        return bag_of_words(rows, key, text, self.language, self.lemma, self.stop, unique)

    def bags(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, terms, tfs), a row for each key."""
        if repeats(rows, key):
            return gathered(self.bag(rows, key, text, unique=False), key)
        if self.language is None and self.stop is None:
            return bags_by_row(rows, key, text)
        return gathered(self.bag(rows, key, text), key)


@dataclass(frozen=True)
class TextIndex:
    """An inverted index: (term, df), and (key, term, w, norm), the norm being that of the whole document.

    df and the norm are stored beside the weights, so that a query reads only the postings of
    its own terms. The bag is stored too, a row for each document: when rows come or go, only new ones are read as text.
    """

    key: str
    n: int
    df: DataFrame
    weighted: DataFrame
    analyzer: Analyzer = field(default=Analyzer())

    @classmethod
    def build(cls, rows: DataFrame, key: str, text: str, analyzer: Analyzer = Analyzer()) -> TextIndex:
        return cls.of_bag(analyzer.bag(rows, key, text), rows.count(), key, analyzer)

    @classmethod
    def of_bag(cls, bag: DataFrame, n: int, key: str, analyzer: Analyzer = Analyzer()) -> TextIndex:
        df = document_frequency(bag)
        weighted = weights(bag, df, n, key)
        return cls(key, n, df, weighted.join(norms(weighted, key), key), analyzer)

    @property
    def norm(self) -> DataFrame:
        return self.weighted.select(self.key, "norm").distinct()

    @classmethod
    def write(cls, path: str, rows: DataFrame, key: str, text: str, analyzer: Analyzer = Analyzer(), old: str | None = None, dead: DataFrame | None = None) -> TextIndex:
        """Store the index of rows; with old, the path of one, of its rows but the dead ones and of rows besides."""
        spark = rows.sparkSession
        every = lambda p: spark.read.option("recursiveFileLookup", True).parquet(p)
        name = lambda p: f"{p}/bag/{uuid.uuid4().hex}"
        rows.select(key).write.parquet(f"{path}/keys/new")
        analyzer.bags(rows, key, text).write.parquet(name(path))
        if old:
            left = lambda df: df if dead is None else df.join(dead.select(key), key, "left_anti")
            left(every(f"{old}/keys")).write.parquet(f"{path}/keys/old")
            held = left(every(f"{old}/bag"))
            (gathered(held, key) if "term" in held.columns else held).write.parquet(name(path))  # earlier versions stored a row for each term
        n = every(f"{path}/keys").count()
        bags = every(f"{path}/bag")
        frequencies(bags).sortWithinPartitions("term").write.parquet(f"{path}/df")
        weighed(bags, spark.read.parquet(f"{path}/df"), n, key).write.parquet(f"{path}/weights")
        return cls.read(spark, path, key, n, analyzer)

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str, n: int | None = None, analyzer: Analyzer = Analyzer()) -> TextIndex:
        if n is None:
            n = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/keys").count()
        return cls(key, n, spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/weights"), analyzer)

    def without(self, term: str) -> TextIndex:
        """The index without a term's postings and df; documents keep the norms they had."""
        other = F.col("term") != F.lit(term)
        return replace(self, df=self.df.where(other), weighted=self.weighted.where(other))

    def query(self, text: str) -> list[tuple[str, float]]:
        """(term, weight) of the query's terms that the collection has; no more than the query has, so they come to the driver."""
        asked = self.analyzer.bag(self.df.sparkSession.createDataFrame([(0, text)], "q int, text string"), "q", "text").select("term", "tf").collect()
        found = dict(self.df.where(F.col("term").isin([t for t, _ in asked])).select("term", "df").collect()) if asked else {}
        return [(t, math.log10(1 + tf) * math.log10(self.n / found[t])) for t, tf in sorted(asked) if t in found]

    def scores(self, text: str) -> DataFrame:
        """(key, score) of all documents of positive cosine with the query."""
        asked = self.query(text)
        size = sum(w * w for _, w in asked) ** 0.5
        weight = F.create_map(*(F.lit(x) for t, w in asked for x in (t, float(w))))[F.col("term")] if asked else F.lit(0.0)
        hit = self.weighted.where(F.col("term").isin([t for t, _ in asked]))
        dots = hit.groupBy(self.key).agg(F.sum(F.col("w") * weight).alias("dot"), F.max("norm").alias("norm"))
        return dots.select(self.key, F.when((F.col("norm") > 0) & F.lit(size > 0), F.col("dot") / (F.col("norm") * F.lit(size or 1.0))).otherwise(0.0).alias("score")).where("score > 0")

    def top(self, text: str, k: int) -> DataFrame:
        """(key, score) of the k best; ties by key. Scores that differ only by rounding count as tied."""
        return self.scores(text).orderBy(F.desc(F.round("score", 12)), self.key).limit(k)


def info(name: str, index: TextIndex, path: str) -> DataFrame:
    """One row about a collection."""
    return index.df.sparkSession.createDataFrame([(name, path, index.n, index.analyzer.language or "simple")], "name string, path string, documents long, analyzer string")


__all__ = ["Analyzer", "TextIndex", "bag_of_words", "document_frequency", "idf", "info", "norms", "postings", "terms", "weights", "without_term"]
