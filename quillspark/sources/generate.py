"""A reproducible synthetic table of ten columns, for tests and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACES = ("Peru", "Chile", "España", "Brasil", "Japan")


def random_rows(spark: SparkSession, n: int, start: str = "2024-01-01 00:00:00", seed: int = 1) -> DataFrame:
    """One row a minute from start: whole number, name, e-mail, date, price, place on Earth, flag and category."""
    r = lambda k: F.rand(seed * 100 + k)
    return spark.range(n).select(
        (F.to_timestamp(F.lit(start)) + F.make_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("timestamp"),
        (F.floor(r(1) * 100_000) + 1).cast("int").alias("random_int"),
        F.concat(F.lit("User_"), F.col("id")).alias("name"),
        F.concat(F.lit("user"), F.col("id"), F.lit("@example.com")).alias("email"),
        F.date_add(F.to_date(F.lit(start)), -F.floor(r(2) * 1095).cast("int")).alias("date"),
        F.round(r(3) * 9999 + 1, 2).alias("price"),
        F.round(r(4) * 180 - 90, 6).alias("latitude"),
        F.round(r(5) * 360 - 180, 6).alias("longitude"),
        (r(6) < 0.5).alias("is_active"),
        F.element_at(F.array(*map(F.lit, _PLACES)), (F.floor(r(7) * len(_PLACES)) + 1).cast("int")).alias("category"),
    )
