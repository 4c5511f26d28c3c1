"""Values: a tagged union of five scalars, as a struct column and on the driver.

A deletion is told by the log's ``op`` column, never by a null value, so 0, false,
'' and empty bytes stay apart from "absent".
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..errors import CorruptDataError, UnexpectedValueError

PUT, DELETE = "P", "D"
#: kind -> field of the struct
FIELDS = {"integer": "i", "float": "f", "text": "t", "boolean": "b", "bytes": "d"}

_TYPES = {"integer": int, "float": float, "text": str, "boolean": bool, "bytes": bytes}

VALUE = StructType(
    [
        StructField("kind", StringType()),
        StructField("i", IntegerType()),
        StructField("f", DoubleType()),
        StructField("t", StringType()),
        StructField("b", BooleanType()),
        StructField("d", BinaryType()),
    ]
)
#: One row a mutation; (cv, ord) is its version: the commit, and its place in it.
LOG = StructType(
    [
        StructField("key", BinaryType(), False),
        StructField("op", StringType(), False),
        StructField("value", VALUE),
        StructField("cv", LongType(), False),
        StructField("ord", IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Value:
    """One cell."""

    kind: str
    data: Any

    def __post_init__(self):
        if type(self.data) is not _TYPES.get(self.kind) or self.kind == "integer" and not -(1 << 31) <= self.data < 1 << 31:
            raise ValueError(f"not a value of kind {self.kind!r}: {self.data!r}")

    @staticmethod
    def of(x: Any) -> Value:
        """The value that a Python object stands for."""
        if isinstance(x, Value):
            return x
        if isinstance(x, (bytearray, memoryview)):
            x = bytes(x)
        for kind, t in _TYPES.items():
            if type(x) is t:
                return Value(kind, x)
        raise ValueError(f"no kind of value: {x!r}")

    def row(self) -> tuple:
        """As a row of the struct column."""
        return (self.kind, *(self.data if k == self.kind else None for k in FIELDS))

    @staticmethod
    def from_row(r: Any) -> Value:
        if r is None or r["kind"] not in FIELDS or r[FIELDS[r["kind"]]] is None:
            raise CorruptDataError("a value without its tag or content")
        x = r[FIELDS[r["kind"]]]
        return Value(r["kind"], bytes(x) if r["kind"] == "bytes" else x)

    def to_json(self) -> list:
        return [self.kind, base64.b64encode(self.data).decode() if self.kind == "bytes" else repr(self.data) if self.kind == "float" else self.data]

    @staticmethod
    def from_json(j: list) -> Value:
        kind, x = j
        return Value(kind, base64.b64decode(x) if kind == "bytes" else float(x) if kind == "float" else x)

    def as_bytes(self) -> bytes:
        if self.kind != "bytes":
            raise UnexpectedValueError(f"a {self.kind} cell read as bytes")
        return self.data

    def footprint(self) -> int:
        """Bytes it counts for against the buffer's budget."""
        return {"integer": 4, "float": 8, "boolean": 1}.get(self.kind) or len(self.data.encode() if self.kind == "text" else self.data)


def typed(kind: str, content: Column) -> Column:
    """A struct column of one kind."""
    parts = [F.lit(kind).alias("kind")]
    for k, f in FIELDS.items():
        parts.append((content if k == kind else F.lit(None)).cast(VALUE[f].dataType).alias(f))
    return F.struct(*parts)


def byte_view(value: str = "value") -> Column:
    """The bytes of a cell; raises for a cell of another kind. Use it above the resolution only."""
    wrong = F.raise_error(F.concat(F.lit("UnexpectedValue: a cell of kind "), F.coalesce(F.col(f"{value}.kind"), F.lit("?"))))
    return F.when(F.col(f"{value}.kind") == "bytes", F.col(f"{value}.d")).otherwise(wrong)


def footprint(key: str = "key", op: str = "op", value: str = "value") -> Column:
    """Key length plus the value's size; a deletion's value counts nothing."""
    size = (
        F.when(F.col(f"{value}.kind") == "integer", 4)
        .when(F.col(f"{value}.kind") == "float", 8)
        .when(F.col(f"{value}.kind") == "boolean", 1)
        .when(F.col(f"{value}.kind") == "text", F.octet_length(f"{value}.t"))
        .otherwise(F.octet_length(f"{value}.d"))
    )
    return F.octet_length(key) + F.when(F.col(op) == PUT, F.coalesce(size, F.lit(0))).otherwise(0)
