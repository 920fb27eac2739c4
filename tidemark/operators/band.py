"""Joins by a range: each left row with the right rows whose number lies above its own by less than a width.

The right side is cut into cells of an eighth of the width, and a cell of many rows into parts; a left
row goes to the parts of all cells that it reaches. What one task compares is a few thousand right rows
with the left rows that reach them, so that tasks become more, not longer, as a table grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: right rows of a part, at most, about
PART = 2_000
#: pairs of one task, about
TASK_PAIRS = 20_000_000


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Pairs with ``x < y AND y < x + width``; the sides have no column names in common. Null and NaN match nothing."""
    cell = lambda v: F.floor(v / F.lit(width / 8))
    far = F.col(x) + F.lit(width)
    r = right.withColumn("__cell", cell(F.col(y))).where(F.col("__cell").isNotNull())
    sizes = r.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select(F.col("__cell").alias("__c"), F.ceil(F.col("n") / PART).alias("__parts"))
    names = [c for c in r.columns if c != "__cell"]
    dealt = r.join(parts, F.col("__cell") == F.col("__c")).select(*names, "__cell", F.pmod(F.xxhash64(*names), F.col("__parts")).alias("__part"))
    reach = left.where(F.col(x) < far).withColumn("__at", F.explode(F.sequence(cell(F.col(x)), cell(far))))
    reach = reach.join(parts, F.col("__at") == F.col("__c")).withColumn("__in", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__c", "__parts")
    most = left.count() * right.count()  # pairs, if all reached all
    n = max(left.sparkSession.sparkContext.defaultParallelism, min(20_000, most // (16 * TASK_PAIRS) + 1))
    pairs = reach.repartition(n, "__at", "__in").join(dealt.repartition(n, "__cell", "__part").hint("merge"), (F.col("__at") == F.col("__cell")) & (F.col("__in") == F.col("__part")) & (F.col(x) < F.col(y)) & (F.col(y) < far))
    return pairs.select(*left.columns, *right.columns)
