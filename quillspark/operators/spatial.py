"""Nearest neighbours, radius search, and summaries of cells of space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.predicates import box, distance

DIST = "_dist"


def closest(rows: DataFrame, columns: Sequence[str], point: Sequence[float], k: int, key: str) -> DataFrame:
    """The k rows nearest to a point with their distance; ties by key. Plans as a top-k, without a full sort."""
    return rows.withColumn(DIST, distance(tuple(columns), tuple(point))).where(F.col(DIST).isNotNull()).orderBy(DIST, key).limit(k)


def radius(rows: DataFrame, columns: Sequence[str], point: Sequence[float], r: float) -> DataFrame:
    """Rows nearer than r with their distance. The box around the ball prunes the scan."""
    low, high = tuple(v - r for v in point), tuple(v + r for v in point)
    near = rows.where(box(tuple(columns), low, high)).withColumn(DIST, distance(tuple(columns), tuple(point)))
    return near.where(F.col(DIST) < float(r))


def cell(columns: Sequence[str], sizes: Sequence[float]) -> Column:
    """Name of the grid cell of a point."""
    return F.concat_ws("_", *(F.floor(F.col(c).cast("double") / F.lit(float(s))).cast("long") for c, s in zip(columns, sizes)))


def bounds(rows: DataFrame, columns: Sequence[str], sizes: Sequence[float]) -> DataFrame:
    """(cell, n, min_c, max_c for each coordinate c): the minimum bounding box of each grid cell."""
    edges = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return rows.where(" and ".join(f"`{c}` is not null" for c in columns)).groupBy(cell(columns, sizes).alias("cell")).agg(F.count("*").alias("n"), *edges)


def z_value(columns: Sequence[str], low: Sequence[float], high: Sequence[float], bits: int = 10) -> Column:
    """Position on a Z-order curve: the bits of the scaled coordinates in turn, so that near points mostly are near on it."""
    total = F.lit(0).cast("long")
    for i, (c, a, b) in enumerate(zip(columns, low, high)):
        span = float(b - a) or 1.0
        scaled = F.least(F.greatest(F.floor((F.col(c).cast("double") - F.lit(float(a))) / F.lit(span) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for bit in range(bits):
            total = total + F.shiftleft(F.shiftright(scaled, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(columns) + i)
    return total
