"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("rtree", "bptree", "seq", "isam", "hash", "brin", "spimi")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    index: str | None = None
    params: tuple[str, ...] = ()


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class Between:
    column: str
    low: str
    high: str


@dataclass(frozen=True)
class TextMatch:
    column: str
    text: str
    k: int


@dataclass(frozen=True)
class ImageMatch:
    column: str
    file: str
    k: int


@dataclass(frozen=True)
class PointEquals:
    columns: tuple[str, ...]
    point: tuple[str, ...]


@dataclass(frozen=True)
class Box:
    columns: tuple[str, ...]
    low: tuple[str, ...]
    high: tuple[str, ...]


@dataclass(frozen=True)
class Closest:
    columns: tuple[str, ...]
    point: tuple[str, ...]
    k: int


@dataclass(frozen=True)
class Radius:
    columns: tuple[str, ...]
    point: tuple[str, ...]
    r: float


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


#: Conditions that rank rows; the others are plain predicates.
RANKED = (Closest, Radius, TextMatch, ImageMatch)


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateIndex:
    table: str
    kind: str
    columns: tuple[str, ...]
    params: tuple[str, ...] = ()


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class DropIndex:
    table: str
    kind: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[str, ...]


@dataclass(frozen=True)
class Copy:
    table: str
    path: str
    limit: int | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] = field(default=())  # empty: all
    where: object | None = None
    limit: int | None = None


def leaves(e: object) -> list:
    """The conditions of an expression, from the left."""
    if e is None:
        return []
    if isinstance(e, Not):
        return leaves(e.of)
    if isinstance(e, (And, Or)):
        return leaves(e.left) + leaves(e.right)
    return [e]
