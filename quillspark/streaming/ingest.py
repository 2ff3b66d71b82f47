"""Continuous appends to a table with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.types import from_text
from ..session import Engine


def csv_stream(engine: Engine, table: str, folder: str) -> DataFrame:
    """New CSV files of a folder as rows of the table's declared types."""
    types = engine.catalog.get(table).types
    raw = engine.spark.readStream.schema(T.StructType([T.StructField(c, T.StringType()) for c in types])).option("header", True).csv(folder)
    return raw.select(*(from_text(F.col(c), t).alias(c) for c, t in types.items()))


def append_stream(engine: Engine, table: str, rows: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch to a table, once: its number is committed together with its rows, so a batch that is replayed after a failure changes nothing."""
    stream = checkpoint.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        engine.append(table, batch, (stream, number))

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
