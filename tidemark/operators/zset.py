"""Z-sets: DataFrames with a trailing ``__weight`` column; all operations are plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.types import WEIGHT


class NegativeWeight(ValueError):
    """More rows were removed than there are."""


def value_columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != WEIGHT]


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    """Rows with one weight."""
    if WEIGHT in df.columns:
        raise ValueError(f"{WEIGHT} is reserved")
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(WEIGHT, -F.col(WEIGHT))


def add(*zs: DataFrame) -> DataFrame:
    """The sum, not consolidated."""
    out = zs[0]
    for z in zs[1:]:
        out = out.unionByName(z)
    return out


def consolidate(z: DataFrame) -> DataFrame:
    """One row for each value (nulls equal each other), weights added, zeros dropped. Partial sums before the shuffle."""
    columns = [F.col(f"`{c}`") for c in value_columns(z)]
    return z.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


#: rows that one task holds at a time, about
TASK_ROWS = 500_000


def dealt(z: DataFrame, rows: int) -> DataFrame:
    """The same rows, dealt out by value to parts of about ``TASK_ROWS``: Spark alone merges parts up to a size in compressed bytes, or to one a core."""
    n = rows // TASK_ROWS + 1
    return z if n <= z.sparkSession.sparkContext.defaultParallelism else z.repartition(n, *[F.col(f"`{c}`") for c in value_columns(z)])


def consolidate_by(z: DataFrame, keys: list[str]) -> DataFrame:
    """Weights added by key columns only."""
    return z.groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def diff(after: DataFrame, before: DataFrame) -> DataFrame:
    """The delta that leads from one Z-set to another."""
    return consolidate(add(after, negate(before)))


def diff_rows(after: DataFrame, before: DataFrame) -> DataFrame:
    """The same for plain row sets with repeats."""
    return diff(weighted(after), weighted(before))


def expand(z: DataFrame) -> DataFrame:
    """Plain rows, each as often as its weight says; rows without a positive weight are absent."""
    n = F.col(WEIGHT)
    return z.where(n > 0).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("__i", WEIGHT)


def parts(delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain rows of the positive and of the negative part."""
    return expand(delta), expand(negate(delta))


def distinct(z: DataFrame) -> DataFrame:
    """Weight 1 for each value of positive weight."""
    return consolidate(z).where(F.col(WEIGHT) > 0).withColumn(WEIGHT, F.lit(1).cast("long"))


def total_weight(z: DataFrame) -> int:
    return z.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).alias("w")).first()["w"]


#: bits of the map by which rows are told that may have one of some values, at most: 16 MB in words
MOST_BITS = 1 << 27
#: rows are told apart by such a map if the values are at most this part of them; else the map's words would cost as much as the rows
FEW = 1 / 4


def few(n: int, rows: int) -> bool:
    """Whether such a map is worth its stage."""
    return rows >= TASK_ROWS and n <= FEW * rows


def near(z: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """``z`` with ``__near``: false only where a row has none of the ``n`` rows of ``values`` in the columns that those have.

    By one bit for each value in a map that is broadcast; only the map's words are shuffled, and where it is too full more rows are near.
    """
    if "map<" in values.schema.simpleString():  # has no hash
        return z.withColumn("__near", F.lit(True))
    bits = min(MOST_BITS, 1 << max(12, (8 * n).bit_length()))
    at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in values.columns]), F.lit(bits).cast("long")).alias("__at")
    words = values.select(at).groupBy(F.expr("shiftright(__at, 6)").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, CAST(__at & 63 AS INT)))").alias("__bits"))
    told = z.select("*", at).withColumn("__of", F.expr("shiftright(__at, 6)")).join(F.broadcast(words), F.col("__of") == F.col("__word"), "left")
    return told.withColumn("__near", F.expr("coalesce(shiftright(__bits, CAST(__at & 63 AS INT)) & 1 = 1, false)")).select(*[F.col(f"`{c}`") for c in z.columns], "__near")


def settle(z: DataFrame, gone: DataFrame, n: int, rows: int) -> DataFrame:
    """The same Z-set of ``rows`` rows, in which none cancel each other: if those of negative weight, ``gone``, are few, only what may equal one of the ``n`` is consolidated."""
    if not few(n, rows):
        return consolidate(dealt(z, rows))
    told = near(z, gone.drop(WEIGHT), n)
    return add(told.where("NOT __near").drop("__near"), consolidate(dealt(told.where("__near").drop("__near"), rows)))


def may_lack(z: DataFrame) -> bool:
    """Whether the weights of a value may add up to less than nothing, judged by 96 bits of hash: only those are shuffled."""
    columns = [F.col(f"`{c}`") for c in value_columns(z)]
    sums = z.groupBy(F.xxhash64(*columns).alias("h"), F.hash(*columns).alias("g")).agg(F.sum(WEIGHT).alias("w"))
    return sums.agg(F.min("w").alias("w")).first()["w"] < 0


def check_non_negative(z: DataFrame, name: str) -> None:
    bad = z.where(F.col(WEIGHT) < 0).limit(1).collect()
    if bad:
        raise NegativeWeight(f"{name}: more rows removed than present, e.g. {bad[0].asDict()}")


def semi(z: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``z`` whose key columns are in ``keys`` (nulls match nulls)."""
    names = keys.columns
    k = keys.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)])
    on = None
    for i, c in enumerate(names):
        same = z[f"`{c}`"].eqNullSafe(k[f"__k{i}"])
        on = same if on is None else on & same
    return z.join(k, on, "left_semi")


def upsert_delta(state: DataFrame, rows: DataFrame, key: str, order: str, op: str | None = None) -> DataFrame:
    """The delta of keyed rows: the last of a key in ``order`` counts; ``op`` = 'd' removes the key.

    ``state`` is a Z-set with one row for each key at most, ``rows`` has its value columns, ``order`` and perhaps ``op``.
    """
    names = value_columns(state)
    last = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("__r")).select("__key", "__r.*")
    keys = last.select(F.col("__key").alias(key))
    old = negate(semi(state, keys))
    new = last if op is None else last.where(F.col(op) != "d")
    return consolidate(add(old.select(*names, WEIGHT), weighted(new.select(*names))))


def join_delta(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, keys: list[str]) -> DataFrame:
    """The delta of an inner equi-join of Z-sets that share ``keys``: three bilinear terms, weights multiplied.

    Unchanged sides are only read where a delta has their keys.
    """

    def term(a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = a.withColumnRenamed(WEIGHT, "__wa"), b.withColumnRenamed(WEIGHT, "__wb")
        return x.join(y, keys).withColumn(WEIGHT, F.col("__wa") * F.col("__wb")).drop("__wa", "__wb")

    return consolidate(add(term(d_left, right), term(left, d_right), term(d_left, d_right)))


def group_delta(state: DataFrame, delta: DataFrame, keys: list[str], sums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Counts and sums by key, kept as group sums: (new state, output delta).

    State: keys, n (rows), and for each name of ``sums`` (name: column) the sum and the count of
    non-nulls. Output rows: keys, n, name, name_n. Groups of no rows are absent.
    """
    names = ["n", *[x for s in sums for x in (s, f"{s}_n")]]
    w = F.col(WEIGHT)
    aggs = [F.sum(w).alias("n")]
    for name, column in sums.items():
        aggs += [F.coalesce(F.sum(F.col(column) * w), F.lit(0)).alias(name), F.sum(F.when(F.col(column).isNotNull(), w).otherwise(0)).alias(f"{name}_n")]
    change = delta.groupBy(*keys).agg(*aggs)
    touched = semi(state, change.select(*keys))
    new = touched.unionByName(change.select(*keys, *names)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]).where(F.col("n") != 0)
    out = diff(weighted(new), weighted(touched))
    untouched = state.join(change.select(*[F.col(k).alias(f"__{k}") for k in keys]), _same(keys), "left_anti")
    return untouched.unionByName(new), out


def _same(keys: list[str]):
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return on
