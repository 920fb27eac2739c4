"""As-of joins: each left row with the nearest right row of its key at, before or after its time.

Both sides are put into one relation, ordered by key and time, and the last (or first) right row
seen is carried along by a window. One shuffle by key, no join, and memory for one row a key: a hot
key is one sorted stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPS = (">=", ">", "<=", "<")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, op: str = ">=", how: str = "left", prefix: str = "right_") -> DataFrame:
    """``left`` with the columns of its match in ``right`` (all but ``on``) named with ``prefix``.

    ``op`` compares the left time with the right time: ``>=`` and ``>`` take the latest earlier row,
    ``<=`` and ``<`` the earliest later one. Null keys or times match nothing. Ties in the right time
    go to the greatest row (the least for ``<=`` and ``<``) in the order of the right columns.
    """
    if op not in OPS:
        raise ValueError(f"op is one of {OPS}")
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    names = [c for c in right.columns if c not in on]
    keys = [f"__k{i}" for i in range(len(on))]
    back = op in (">=", ">")
    matched = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in names])
    whole = F.struct(*[F.col(c) for c in left.columns])
    known = None
    for c in [*on, right_time]:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    none_l, none_r = F.lit(None).cast(left.select(whole.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(matched.alias("x")).schema["x"].dataType)
    # at equal times: for >= and < the right row comes first, for > and <= the left row
    first = 0 if op in (">=", "<") else 1
    a = left.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(left_time).alias("__t"), F.lit(1 - first).alias("__side"), whole.alias("__l"), none_r.alias("__r"))
    b = right.where(known).select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(right_time).alias("__t"), F.lit(first).alias("__side"), none_l.alias("__l"), matched.alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__r") if keys else Window.orderBy("__t", "__side", "__r")
    seen = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("__r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    out = a.unionByName(b).withColumn("__m", F.when(usable, seen)).where(F.col("__l").isNotNull())
    if how == "inner":
        out = out.where(F.col("__m").isNotNull())
    return out.select("__l.*", *[F.col(f"__m.{prefix}{c}").alias(f"{prefix}{c}") for c in names])
