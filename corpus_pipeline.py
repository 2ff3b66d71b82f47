"""A cleaning pipeline over ``documents``; each stage's result is written as Parquet and read again as the next one's input.

Stages are written to the folder in spark.checkpoint.dir, which all executors share.

Defined cases, over all stages: a null or empty text is clean, of no class but its own, and packed as one end token;
texts are worked on whole, however long; documents of which a stage's score is exactly at its threshold are toxic, or kept as good, and are near
copies; of rows that repeat a doc_id and its text one stays, rows that repeat a doc_id with another text go or stay together; rows of a null doc_id
(or one that is no whole number) are kept by the stage of near copies; further columns, whatever their names, pass through all stages but the last; an
empty table gives an empty result. The stages' modules say more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import ngram_join, packing, quality, secrets, toxicity
from quillspark.llm.common import folder, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near copies", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: The classifiers are trained, so no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    shared, docs = folder(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
