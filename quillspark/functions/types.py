"""Declared SQL types, their Spark types, and the casting of literals and of text read from files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid

_PLAIN = {
    "int": T.IntegerType(), "long": T.LongType(), "ulong": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "text": T.StringType(), "file": T.StringType(), "varchar": T.StringType(),
}
#: Bytes kept of a text or file name; None keeps all.
_BYTES = {"text": None, "file": 255}


@dataclass(frozen=True)
class SqlType:
    name: str
    size: int | None = None

    @classmethod
    def parse(cls, text: str) -> SqlType:
        m = re.fullmatch(r"\s*([a-z]+)\s*(?:\[\s*(\d+)\s*\])?\s*", text.lower())
        if not m or m[1] not in _PLAIN or (m[1] == "varchar") != (m[2] is not None):
            raise Invalid(f"unknown type {text!r}")
        return cls(m[1], int(m[2]) if m[2] else None)

    def __str__(self) -> str:
        return self.name if self.size is None else f"{self.name}[{self.size}]"

    @property
    def spark(self) -> T.DataType:
        return _PLAIN[self.name]

    @property
    def limit(self) -> int | None:
        return self.size if self.name == "varchar" else _BYTES.get(self.name)


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of a string that has at most limit bytes of UTF-8; a character is never split."""
    raw = F.substring(c.cast("binary"), 1, limit + 1)
    # a continuation byte after the limit means that the character around it is cut off
    head = F.substring(c.cast("binary"), 1, limit)
    tail = F.hex(head)
    whole = F.regexp_replace(tail, r"^((?:[0-9A-F]{2})*?)(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", "$1")
    return F.when(F.octet_length(raw) <= limit, c).otherwise(F.unhex(whole).cast("string"))


def from_text(c: Column, t: SqlType) -> Column:
    """A value of type t from its text form; booleans are 0/1/true/false, timestamps may have a T or a blank."""
    if t.name == "bool":
        low = F.lower(F.trim(c))
        return F.when(low.isin("1", "true", "t"), F.lit(True)).when(low.isin("0", "false", "f"), F.lit(False))
    if t.limit is not None:
        return cut_bytes(c, t.limit)
    if t.spark == T.StringType():
        return c
    return F.trim(c).try_cast(t.spark)


#: What an error of ``strict`` begins with.
BAD_VALUE = "bad value: "


def strict(c: Column, t: SqlType) -> Column:
    """As ``from_text``, but a value of another type is an error of the query."""
    value = from_text(c, t)
    if t.spark == T.StringType():
        return value
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{BAD_VALUE}no {t}: "), c))).otherwise(value)


def literal(value: str, t: SqlType) -> Column:
    """A literal of a condition, typed by the column it is compared with; numbers stay 64 bits wide."""
    if t.name == "bool":
        low = value.strip().lower()
        if low not in ("0", "1", "true", "false"):
            raise Invalid(f"{value!r} is no bool")
        return F.lit(low in ("1", "true"))
    if t.spark == T.StringType():
        return F.lit(value)
    if t.name in ("date", "timestamp"):
        return F.lit(value).cast(t.spark)
    try:
        number = float(value)
    except ValueError:
        raise Invalid(f"{value!r} is no {t}") from None
    if t.name in ("float", "double"):
        return F.lit(number)
    return F.lit(value).cast("decimal(20,0)") if re.fullmatch(r"-?\d{10,20}", value) else F.lit(int(number) if number == int(number) else number)
