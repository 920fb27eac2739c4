"""Definitions of sources, tables, views and sinks, and the SQL types they may have."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

WEIGHT = "__weight"

#: SQL spellings of each type. Fixed values.
_SPELLINGS = {
    "bigint": ("INT", "INTEGER", "BIGINT", "INT8", "INT64"),
    "boolean": ("BOOL", "BOOLEAN"),
    "string": ("VARCHAR", "CHAR", "CHARACTER", "TEXT", "STRING"),
    "timestamp_ntz": ("TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"),
    "date": ("DATE", "DATE32"),
    "decimal": ("NUMERIC", "DECIMAL", "DEC", "BIGNUMERIC"),
}
_NAMES = {s: k for k, names in _SPELLINGS.items() for s in names}


class DefinitionError(ValueError):
    """A statement or definition that is not accepted."""


def sql_type(text: str) -> T.DataType:
    """The Spark type of a column's declared SQL type; NUMERIC without precision is kept as text."""
    m = re.fullmatch(r"\s*([A-Za-z_0-9]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    kind = _NAMES.get(m[1].upper()) if m else None
    if kind is None:
        raise DefinitionError(f"unsupported type {text.strip()!r}")
    if kind == "decimal":
        if m[2] is None:
            return T.StringType()
        p, s = int(m[2]), int(m[3] or 0)
        if not 1 <= p <= 38 or s > p:
            raise DefinitionError(f"decimal({p},{s}) is out of range")
        return T.DecimalType(p, s)
    return {"bigint": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType()}[kind]


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = True


@dataclass
class SourceDef:
    """A stream or table of rows. ``primary_key`` makes it keyed (the last row of a key counts)."""

    name: str
    columns: list[Column]
    properties: dict[str, str] = field(default_factory=dict)
    primary_key: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    @property
    def append_only(self) -> bool:
        return self.primary_key is None and self.properties.get("append_only", "true").lower() == "true"

    @property
    def event_time(self) -> str | None:
        """The first timestamp column."""
        return next((c.name for c in self.columns if isinstance(c.type, T.TimestampNTZType | T.TimestampType)), None)


@dataclass
class ViewDef:
    name: str
    sql: str
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class SinkDef:
    name: str
    view: str
    properties: dict[str, str] = field(default_factory=dict)
