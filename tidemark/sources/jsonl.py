"""JSON rows: lines of files or of a stream, plain or wrapped as {"source", "data"}, single or arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.types import SourceDef


def events(lines: DataFrame, column: str, default_source: str | Column) -> DataFrame:
    """(source, payload) of JSON lines: blank lines are skipped, arrays opened, wrappers taken off."""
    default = F.lit(default_source) if isinstance(default_source, str) else default_source
    line = F.trim(F.col(column))
    one = F.when(line.startswith("["), F.from_json(line, "array<string>", {"mode": "FAILFAST"})).otherwise(F.array(line))
    rows = lines.where(F.length(line) > 0).select(F.explode(one).alias("e"), default.alias("default"))
    source, data = F.get_json_object("e", "$.source"), F.get_json_object("e", "$.data")
    wrapped = source.isNotNull() & data.isNotNull() & data.startswith("{")
    return rows.select(F.when(wrapped, source).otherwise(F.col("default")).alias("source"), F.when(wrapped, data).otherwise(F.col("e")).alias("payload"))


def decode(rows: DataFrame, payload: str, source: SourceDef, keep: list[str] | None = None, only: set[str | None] | None = None) -> DataFrame:
    """Typed rows: unknown keys are ignored, a missing nullable is null, a missing non-nullable or a wrong type an error.

    Timestamps are milliseconds since the epoch or text; decimals are text or numbers. ``keep``: columns of
    ``rows`` that stay beside the source's. ``only``: columns to parse, the others are null.
    """
    def raw(c) -> T.DataType:
        if isinstance(c.type, T.TimestampNTZType | T.DecimalType | T.DateType | T.StringType):
            return T.StringType()
        return c.type

    parsed_ones = [c for c in source.columns if only is None or c.name in only] or source.columns[:1]
    schema = T.StructType([T.StructField(c.name, raw(c), True) for c in parsed_ones])
    parsed = rows.select(F.from_json(F.col(payload), schema, {"mode": "FAILFAST"}).alias("r"), *(keep or []))
    out = [F.col(c) for c in keep or []]
    for c in source.columns:
        if c not in parsed_ones:
            out.append(F.lit(None).cast(c.type).alias(c.name))
            continue
        v = F.col(f"r.`{c.name}`")
        if isinstance(c.type, T.TimestampNTZType):
            ms = F.timestamp_millis(F.when(v.rlike(r"^-?\d+$"), v).cast("long"))
            v = F.when(v.rlike(r"^-?\d+$"), F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ms.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSS"))).otherwise(F.when(~v.rlike(r"^-?\d+$"), v).cast(T.TimestampNTZType()))
        elif raw(c) != c.type:
            v = v.cast(c.type)
        if not c.nullable:
            v = F.coalesce(v, F.raise_error(F.lit(f"{source.name}.{c.name} is missing")).cast(c.type))
        out.append(v.alias(c.name))
    return parsed.select(*out)


def read(spark: SparkSession, path: str, source: SourceDef) -> DataFrame:
    """A JSONL file, folder or prefix of any store, whole."""
    found = events(spark.read.text(path), "value", source.name)
    return decode(found.where(F.col("source") == source.name), "payload", source)


def stream(spark: SparkSession, path: str, default_source: str) -> DataFrame:
    """The lines of a folder that grows, as (source, payload)."""
    return events(spark.readStream.text(path), "value", default_source)


def kafka(spark: SparkSession, servers: str, topics: str, **options) -> DataFrame:
    """Topics as (source, payload), the topic being the default source. Needs Spark's Kafka package on the class path."""
    try:
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load()
    except Exception as e:
        if "kafka" in str(e).lower():
            raise RuntimeError("Spark's Kafka package is not on the class path") from e
        raise
    return events(raw.select(F.col("topic"), F.col("value").cast("string").alias("line")).where("line is not null"), "line", F.col("topic"))
