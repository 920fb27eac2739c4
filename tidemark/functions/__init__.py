"""SQL functions that Spark lacks, as temporary SQL functions: they are inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_US = f"timestampdiff(MICROSECOND, {_EPOCH}, ts)"

#: name, parameters, type, body
_FUNCTIONS = [
    ("tumble", "ts TIMESTAMP_NTZ, size BIGINT", "TIMESTAMP_NTZ", f"CASE WHEN size > 0 THEN timestampadd(MICROSECOND, {_US} - pmod({_US}, size * 1000), {_EPOCH}) END"),
    ("tumble_start", "ts TIMESTAMP_NTZ, size BIGINT", "TIMESTAMP_NTZ", "tumble(ts, size)"),
    ("tumble_end", "ts TIMESTAMP_NTZ, size BIGINT", "TIMESTAMP_NTZ", "timestampadd(MILLISECOND, size, tumble(ts, size))"),
    ("tumble_rowtime", "ts TIMESTAMP_NTZ, size BIGINT", "TIMESTAMP_NTZ", "tumble_end(ts, size) - INTERVAL '0.001' SECOND"),
    ("hop_starts", "ts TIMESTAMP_NTZ, slide BIGINT, size BIGINT", "ARRAY<TIMESTAMP_NTZ>", f"transform(sequence({_US} - pmod({_US}, slide * 1000), {_US} - pmod({_US}, slide * 1000) - (size DIV slide - 1) * slide * 1000, -slide * 1000), x -> timestampadd(MICROSECOND, x, {_EPOCH}))"),
    ("proctime", "", "TIMESTAMP", "current_timestamp()"),
    ("split_index", "s STRING, delim STRING, i INT", "STRING", "CASE WHEN i < 0 OR length(delim) = 0 THEN NULL ELSE get(split(s, concat('\\\\Q', replace(delim, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')), i) END"),
    ("count_char", "s STRING, token STRING", "BIGINT", "CASE WHEN length(token) = 0 AND s IS NOT NULL THEN 0 ELSE CAST((length(s) - length(replace(s, token, ''))) DIV length(token) AS BIGINT) END"),
    ("regexp_extract_or_null", "s STRING, pattern STRING, idx INT", "STRING", "CASE WHEN idx < 0 OR NOT s RLIKE pattern THEN NULL ELSE regexp_extract(s, pattern, idx) END"),
    ("hop_start", "ts TIMESTAMP_NTZ, slide BIGINT, size BIGINT", "TIMESTAMP_NTZ", "CASE WHEN slide > 0 AND size > 0 THEN tumble(ts, slide) END"),
    ("hop_end", "ts TIMESTAMP_NTZ, slide BIGINT, size BIGINT", "TIMESTAMP_NTZ", "timestampadd(MILLISECOND, size, hop_start(ts, slide, size))"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session. ``proctime`` is the current time; in a strict dialect it is NULL."""
    for name, params, kind, body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
