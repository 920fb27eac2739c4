"""The first rows of a table that change data then keeps: read by key ranges over JDBC, at a known position of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.engine import Engine
from tidemark.types import DefinitionError, SourceDef


def read_table(spark: SparkSession, url: str, table: str, source: SourceDef, chunks: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """The table's declared columns, in ``chunks`` ranges of its whole-number key, each one task; else in one."""
    options = dict(properties or {})
    key = next((c for c in source.columns if c.name == source.primary_key), None)
    if key is None:
        raise DefinitionError(f"{source.name} has no primary key")
    whole = spark.read.jdbc(url, table, properties=options)
    if key.type.typeName() in ("long", "integer", "short", "byte"):
        low, high = whole.agg(F.min(key.name), F.max(key.name)).first()
        if low is not None and high > low:
            whole = spark.read.jdbc(url, table, column=key.name, lowerBound=low, upperBound=high + 1, numPartitions=chunks, properties=options)
    return whole.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in source.columns])


def load(engine: Engine, name: str, rows: DataFrame, position: int) -> int:
    """Fill a table with its rows as of ``position`` in the log; later envelopes up to that position are passed over.

    A snapshot that is loaded again after a restart changes nothing.
    """
    if name not in engine.sources or engine.sources[name].primary_key is None:
        raise DefinitionError(f"{name} is no table")
    engine.store.manifest.setdefault("positions", {})[name] = position
    return engine.apply({name: rows}, batch_id=f"snapshot.{name}:{position}")
