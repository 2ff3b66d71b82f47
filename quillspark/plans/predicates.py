"""Conditions as Catalyst columns, so that they are pushed to the scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Invalid, NotFound
from ..functions.types import SqlType, literal
from . import ast as A

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
REL, ABS = 1e-9, 1e-6


def point_equals(columns: tuple[str, ...], point: tuple[float, ...]) -> Column:
    """Every coordinate equal but for rounding: within 1e-6, or 1e-9 of the larger value. A plain range is added for the scan to prune by."""
    out = []
    for c, v in zip(columns, point):
        reach = max(ABS, REL * abs(v) * (1 + 1e-6))
        out.append(F.col(c).between(v - reach, v + reach))
        out.append(F.abs(F.col(c) - v) <= F.greatest(REL * F.greatest(F.abs(F.col(c)), F.lit(abs(v))), F.lit(ABS)))
    return reduce(and_, out)


def box(columns: tuple[str, ...], low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    return reduce(and_, (F.col(c).between(a, b) for c, a, b in zip(columns, low, high)))


def distance(columns: tuple[str, ...], point: tuple[float, ...]) -> Column:
    """Euclidean distance."""
    total = reduce(lambda a, b: a + b, ((F.col(c).cast("double") - F.lit(float(v))) * (F.col(c).cast("double") - F.lit(float(v))) for c, v in zip(columns, point)))
    return F.sqrt(total)


def numbers(point: tuple[str, ...]) -> tuple[float, ...]:
    try:
        return tuple(float(v) for v in point)
    except ValueError:
        raise Invalid(f"{point} is no point") from None


def column(e: object, types: Mapping[str, SqlType], ranked: Callable[[object], Column]) -> Column:
    """A condition as a boolean column; ranked gives the column that stands for a ranking's members."""
    if isinstance(e, A.Not):
        return ~column(e.of, types, ranked)
    if isinstance(e, A.And):
        return column(e.left, types, ranked) & column(e.right, types, ranked)
    if isinstance(e, A.Or):
        return column(e.left, types, ranked) | column(e.right, types, ranked)
    if isinstance(e, A.RANKED):
        return ranked(e)
    if isinstance(e, A.PointEquals):
        return point_equals(e.columns, numbers(e.point))
    if isinstance(e, A.Box):
        return box(e.columns, numbers(e.low), numbers(e.high))
    if e.column not in types:
        raise NotFound(f"no column {e.column}")
    t = types[e.column]
    if isinstance(e, A.Between):
        return F.col(e.column).between(literal(e.low, t), literal(e.high, t))
    return _OPS[e.op](F.col(e.column), literal(e.value, t))


def used_columns(e: object) -> list[str]:
    return [c for leaf in A.leaves(e) for c in (leaf.columns if hasattr(leaf, "columns") else (leaf.column,))]


def conjuncts(e: object) -> list:
    """The parts that all have to hold."""
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.And) else [] if e is None else [e]
