"""Connected components of an edge table, by alternating large and small stars.

Each round turns every node's edges towards the least node it sees, first to its larger neighbours,
then to its smaller ones; paths shrink to stars in logarithmic rounds. A round is aggregates and
joins on the nodes with map-side minima; no neighbourhood is ever collected. Each round is written to
the shared scratch folder, so a lost executor costs one round, and the round before it is deleted.

The minima are joined by a struct of the node: so they don't stay in the partitions that they were
aggregated in, both sides are shuffled for the join alone, and Spark can split the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard

FILE_ROWS = 1 << 18


def _with(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) and the minimum m of each u."""
    return edges.select(F.struct("u").alias("w"), "v").join(least.select(F.struct("u").alias("w"), "m"), "w")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component, for each node of the edges u, v (of one orderable type)."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    files, before = max(8, -(-now.count() // FILE_ROWS)), None
    while True:
        # large star: each node's larger neighbours go to the least of its neighbours and itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours go to the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small.coalesce(files))  # edges only become fewer
        discard(now)
        now = new
        state = now.agg(F.count("*").alias("n"), F.countDistinct("v").alias("roots"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
