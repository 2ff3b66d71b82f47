"""Text analysis: from texts to bags of words in long form (id, term, tf)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stemming import STEMMERS

#: Characters of text whose terms leave a worker together.
_BLOCK = 1_000_000
_LETTERS: list[np.ndarray] = []


def terms(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _LETTERS[0]


def words_of(text: str) -> list[str]:
    """``terms`` of one text: everything but letters becomes a blank at once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(" ")


def _bag(text: str | None) -> dict[str, int]:
    bag = Counter(words_of(text)) if text else Counter()
    bag.pop("", None)
    return bag


def _counted(batches: Iterator[pa.RecordBatch], count: Callable[[str | None], dict[str, int]] = _bag, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """(key, term, tf) of batches (key, text), row by row; whole: (key, terms, tfs), a row for each text."""
    for batch in batches:
        names, held, rows, counts, found = batch.schema.names, 0, [], [], []

        def out() -> pa.RecordBatch:
            terms, tfs = pa.array([t for f in found for t in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.int64())
            if whole:
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)], names=[names[0], "terms", "tfs"])
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(rows, counts), pa.int64())), terms, tfs], names=[names[0], "term", "tf"])

        for i, text in enumerate(batch.column(1).to_pylist()):
            bag = count(text)
            rows.append(i)
            counts.append(len(bag))
            found.append(bag)
            held += len(text or "")
            if held >= _BLOCK:
                yield out()
                held, rows, counts, found = 0, [], [], []
        if rows:
            yield out()


def stop_words(language: str) -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def stop_list(spark: SparkSession, path: str) -> list[str]:
    """The words of a stop list, one to a line."""
    return sorted({r.value.strip().lower() for r in spark.read.text(path).collect()} - {""})  # a list of a few hundred words


def stem(c: Column, language: str) -> Column:
    """Stems of single terms, a batch at a time."""
    one = STEMMERS[language]

    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        known = {t: one(t) for t in s.dropna().unique()}
        return s.map(known)

    return work(c)


def _counter(language: str, stop: Sequence[str]) -> Callable[[str | None], dict[str, int]]:
    """The bag of a text in which every token that is no stop word counts as itself and as its stem."""
    one, left_out = STEMMERS[language], frozenset(stop)

    def count(text: str | None) -> dict[str, int]:
        plain = _bag(text)
        out = {t: n for t, n in plain.items() if t not in left_out}
        for t, n in list(out.items()):
            s = one(t)
            out[s] = out.get(s, 0) + n
        return out

    return count


def bag_of_words(rows: DataFrame, key: str, text: str, language: str | None = None, lemma: Callable[[Column], Column] | None = None, stop: Sequence[str] | None = None, unique: bool | None = False) -> DataFrame:
    """(key, term, tf).

    Without a language: plain terms. With one: stop words (those of the language, or the ones given) are left out and every
    token counts twice, as its lemma (itself, unless a lemma function is given) and as its stem.
    Stems are made where a text is read, once per distinct term of it at most; with a lemma function once per distinct term of all. unique: no two
    rows have the same key, so that the terms of a row, counted where it is read, need no shuffle; None finds that out.
    """
    kind = rows.schema[key].dataType.simpleString()
    if unique is None:
        unique = not repeats(rows, key)
    if language is not None and lemma is None:
        count = _counter(language, stop_words(language) if stop is None else stop)
        both = rows.select(key, F.col(text).cast("string").alias("text")).mapInArrow(lambda batches: _counted(batches, count), f"`{key}` {kind}, term string, tf long")
        return both if unique else both.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    counted = rows.select(key, F.col(text).cast("string").alias("text")).mapInArrow(_counted, f"`{key}` {kind}, term string, tf long")
    if not unique:
        counted = counted.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    if language is None:
        return counted if stop is None else counted.where(~F.col("term").isin(list(stop)))
    counted = counted.where(~F.col("term").isin(stop_words(language) if stop is None else list(stop)))
    forms = counted.select("term").distinct().withColumn("stem", stem(F.col("term"), language))
    forms = forms.withColumn("lemma", lemma(F.col("term")))
    both = counted.join(forms, "term").select(key, F.explode(F.array("lemma", "stem")).alias("term"), "tf")
    return both.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether two rows have the same key; reads the keys only."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def bags_by_row(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, tfs): the plain bag of words of each row, as two arrays; keys must not repeat."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string").alias("text")).mapInArrow(lambda batches: _counted(batches, whole=True), f"`{key}` {kind}, terms array<string>, tfs array<long>")


def gathered(bag: DataFrame, key: str) -> DataFrame:
    """(key, terms, tfs) of (key, term, tf)."""
    return bag.groupBy(key).agg(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"))).alias("b")).select(key, F.col("b.term").alias("terms"), F.col("b.tf").alias("tfs"))
