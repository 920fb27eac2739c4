"""Change data: envelopes and row changes to weighted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import zset
from tidemark.sources.jsonl import decode
from tidemark.types import WEIGHT, SourceDef


class Truncated(ValueError):
    """A truncate arrived; it has no delta."""


def envelopes(rows: DataFrame, payload: str, source: SourceDef, as_rows: bool = False) -> DataFrame:
    """Debezium envelopes to weighted rows: c and r add ``after``, d takes ``before`` away, u does both; null is skipped.

    ``as_rows`` takes every change as one plain row, the last image there is.
    """
    body = F.coalesce(F.get_json_object(payload, "$.payload"), F.col(payload))
    e = rows.where(F.col(payload).isNotNull()).select(F.get_json_object(body, "$.op").alias("op"), F.get_json_object(body, "$.before").alias("before"), F.get_json_object(body, "$.after").alias("after")).where("op is not null")
    e = e.withColumn("op", F.when(F.col("op") == "t", F.raise_error(F.lit("truncate has no delta"))).otherwise(F.col("op")))
    if as_rows:
        kept = e.select(F.coalesce("after", "before").alias("p"), "op")
        return decode(kept, "p", source)
    plus = e.where(F.col("op").isin("c", "r", "u") & F.col("after").isNotNull()).select(F.col("after").alias("p"))
    minus = e.where(F.col("op").isin("d", "u") & F.col("before").isNotNull()).select(F.col("before").alias("p"))
    return zset.add(zset.weighted(decode(plus, "p", source)), zset.weighted(decode(minus, "p", source), -1))


def table_delta(state: DataFrame, rows: DataFrame, payload: str, source: SourceDef, table: str | None = None, after: int | None = None) -> DataFrame:
    """The delta of a keyed table from Debezium envelopes: the last image of each key, by the position in the log.

    Images before a change aren't needed. ``table``: ``schema.name``; envelopes of other tables are passed over,
    as are those up to position ``after``, which a snapshot holds.
    """
    body = F.coalesce(F.get_json_object(payload, "$.payload"), F.col(payload))
    at = lambda path: F.get_json_object("body", path)
    e = rows.where(F.col(payload).isNotNull()).select(body.alias("body"), F.monotonically_increasing_id().alias("nth")).where(at("$.op").isNotNull())
    if table:
        schema, _, name = table.rpartition(".")
        e = e.where((at("$.source.table") == name) & (F.lit(not schema) | F.coalesce(at("$.source.schema") == schema, F.lit(False))))
    e = e.withColumn("op", F.when(at("$.op") == "t", F.raise_error(F.lit("truncate has no delta"))).otherwise(at("$.op")))
    order = F.struct(F.coalesce(at("$.source.lsn"), at("$.ts_ms"), F.lit("0")).cast("long").alias("lsn"), F.col("nth"))
    if after is not None:
        e = e.where(order["lsn"] > after)
    loose = SourceDef(source.name, [type(c)(c.name, c.type, True) for c in source.columns], source.properties, source.primary_key)
    images = []
    for gone, image in ((False, at("$.after")), (True, at("$.before"))):
        some = e.where((F.col("op") == "d") == F.lit(gone)).select(image.alias("p"), order.alias("__o")).where("p IS NOT NULL")
        images.append(decode(some, "p", loose if gone else source, keep=["__o"]).withColumn("__d", F.lit("d" if gone else "u")))
    return zset.upsert_delta(state, images[0].unionByName(images[1]), source.primary_key, "__o", "__d")


def apply_changes(state: DataFrame, changes: DataFrame, key: str, lsn: str = "lsn", op: str = "op", unchanged: str | None = "__unchanged") -> DataFrame:
    """The delta of a transaction's row changes on a keyed table (a Z-set, one row a key).

    ``changes``: the table's columns, ``op`` (insert, update, delete), ``lsn`` for their order, perhaps
    ``old_key`` (the key before an update) and ``unchanged``: names of columns not sent, which keep
    the value they had. Several changes of a key end in its last.
    """
    names = zset.value_columns(state)
    if not changes.where(F.col(op) == "truncate").isEmpty():
        raise Truncated("truncate has no delta")
    moved = None
    if "old_key" in changes.columns:
        gone = changes.where((F.col(op) == "update") & F.col("old_key").isNotNull() & ~F.col("old_key").eqNullSafe(F.col(key)))
        moved = gone.select(*[F.col("old_key").alias(key) if n == key else F.col(n) for n in names], (F.col(lsn) - 0.5).cast("double").alias("__o"), F.lit("d").alias("__d"))
    rows = changes
    if unchanged in changes.columns:
        was = "old_key" if "old_key" in changes.columns else key
        old = state.drop(WEIGHT).select(*[F.col(n).alias(f"__old_{n}") for n in names])
        rows = rows.join(old, F.coalesce(F.col(was), F.col(key)) == F.col(f"__old_{key}"), "left")
        rows = rows.select(*[F.when(F.array_contains(F.coalesce(F.col(unchanged), F.array().cast("array<string>")), n), F.col(f"__old_{n}")).otherwise(F.col(n)).alias(n) for n in names], lsn, op)
    last = rows.select(*names, F.col(lsn).cast("double").alias("__o"), F.when(F.col(op) == "delete", "d").otherwise("u").alias("__d"))
    if moved is not None:
        last = last.unionByName(moved)
    return zset.upsert_delta(state, last, key, "__o", "__d")


def schema_change(old: T.StructType, new: T.StructType) -> str:
    """unchanged, compatible_addition (nullable columns appended) or incompatible."""
    a, b = ([(f.name, f.dataType) for f in s.fields] for s in (old, new))
    if a == b:
        return "unchanged"
    if b[: len(a)] == a and all(f.nullable for f in new.fields[len(a) :]):
        return "compatible_addition"
    return "incompatible"


def admit(old: T.StructType, new: T.StructType, policy: str) -> T.StructType:
    """The schema to go on with under fail_fast, ignore_compatible or apply_compatible_additions."""
    change = schema_change(old, new)
    if change == "unchanged":
        return old
    if change == "incompatible" or policy == "fail_fast":
        raise ValueError(f"schema change: {change}")
    return new if policy == "apply_compatible_additions" else old
