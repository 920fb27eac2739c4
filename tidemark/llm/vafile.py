"""Exact top-k by integer inner product with a vector-approximation file.

The file is written once, to the shared scratch folder: rows of at most ``BLOCK`` vectors of one
length, each with its vectors' ids, one byte for each component (the cell of an equal division of that
component's range in the block) and, in a column that a scan of the cells doesn't read, the exact
integers. Equal vectors of a block are kept once, with as many of their least ids as can be results.

A scan of the cells gives a lower and an upper bound of every score. A task keeps each query's k best
lower bounds and passes on only what may still reach them. Over all tasks, the k-th best lower bound
of a query is its bar; the exact vectors of those whose upper bound reaches it are read, block by
block, in the order of their bounds, until no other of the block can reach the k-th exact score there.
The bounds are computed in doubles and widened by what rounding can amount to; scores are exact.

Queries come in passes of at most ``QUERY_BLOCK`` vectors and ``QUERY_BYTES``: a pass is a bounded
broadcast, a scan of the cells by all tasks, and a read of a few exact vectors. Its broadcast is
destroyed and its results are written before the next one.

Defined results: vectors that are null, or hold null, NaN or infinite components (also after scaling),
take no part, nor rows without an id; vectors score only against vectors of the same length; a repeated
row is a candidate of its own, but rows with the query's own id are not its candidates; an id that
repeats asks once, with its least vector; ties in the score go to the smaller id; scores beyond 64 bits
are held at the limits, and tie there. An empty table gives an empty one. Only the two named columns
and those of ``is_query`` are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, cut, discard, scratch

K = 10
QUERY_BLOCK, QUERY_BYTES = 2_048, 8 << 20
BLOCK, BLOCK_BYTES = 1_024, 1 << 20
CELLS = 256
EDGE = 2**63 - 1

_FILE = "block long, dim int, ids binary, low binary, width binary, cells binary, exact binary"
_CANDIDATE = "query_id long, block long, pos int, lower double, upper double"


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 1024) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def scaled(vector: np.ndarray) -> np.ndarray:
    return np.floor(1024.0 * vector.astype(np.float64))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` (whole numbers in doubles) as 64-bit integers, in a type that holds them."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([max(-EDGE - 1, min(EDGE, sum(int(x) * int(y) for x, y in zip(v, w, strict=True)))) for v, w in zip(a, b, strict=True)], dtype=np.int64)


def best_of(q: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best: highest score, then smallest id."""
    order = np.lexsort((vec, ~score, q))  # ~ turns the order of integers round without leaving them
    qs = q[order]
    return order[np.arange(len(qs)) - np.searchsorted(qs, qs) < k]


def _deduplicated(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows of a block to keep: of equal vectors k rows of an id, and the 2k rows of the least ids."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    flat = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
    same = np.unique(flat.view(np.dtype((np.void, max(1, flat.shape[1] * 8)))).ravel(), return_inverse=True)[1].ravel() if flat.shape[1] else np.zeros(len(ids), dtype=np.int64)
    order = np.lexsort((ids, same))
    for key in ((same, ids), (same,)):
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in key])
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - start < (k if len(key) == 2 else 2 * k)]
    return np.sort(order)


def _file(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for d in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == d))
                ids = some.column(0).to_numpy(zero_copy_only=False)
                vectors = scaled(some.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), d)
                kept = _deduplicated(vectors, ids, k)
                ids, vectors = ids[kept], vectors[kept]
                step = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, d))))
                for at in range(0, len(ids), step):
                    v = vectors[at : at + step]
                    low = v.min(0)
                    width = np.maximum(np.ceil((v.max(0) - low + 1) / CELLS), 1.0)
                    cells = np.clip((v - low) // width, 0, CELLS - 1).astype(np.uint8)
                    out.append((block, d, ids[at : at + step].tobytes(), low.tobytes(), width.tobytes(), cells.tobytes(), v.tobytes()))
                    block += 1
            for at in range(0, len(out), 8):
                cols = list(zip(*out[at : at + 8], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=[x.split()[0] for x in _FILE.split(", ")])

    return run


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores [vectors, queries], whatever the vectors in the cells are."""
    with np.errstate(over="ignore", invalid="ignore"):
        corner = cells.astype(np.float64) @ (queries * width).T + low @ queries.T  # the score of each cell's lowest corner
        top = np.maximum(np.abs(low), np.abs(low + CELLS * width))
        slack = (3 * top @ np.abs(queries).T) * ((cells.shape[1] + 8) * 2.0**-52)  # a cell's corner and its sums are rounded
        span = width - 1
        lower, upper = corner + (np.minimum(queries, 0) @ span - slack), corner + (np.maximum(queries, 0) @ span + slack)
    lower[np.isnan(lower)] = -np.inf
    upper[np.isnan(upper)] = np.inf
    return np.clip(lower, -(2.0**63), 2.0**63), np.clip(upper, -(2.0**63), 2.0**63)  # as the scores are held


class Bars:
    """Each query's k best lower bounds so far in this task."""

    def __init__(self, n: int, k: int):
        self.low = np.full((n, k), -np.inf)

    def add(self, lower: np.ndarray, at: slice) -> np.ndarray:
        k = self.low.shape[1]
        best = lower if len(lower) <= k else np.partition(lower, len(lower) - k, axis=0)[-k:]
        self.low[at] = np.partition(np.concatenate([self.low[at], best.T], 1), len(best), axis=1)[:, -k:] if len(best) else self.low[at]
        return self.low[at].min(1)


def _scan(shared, k: int, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars = {d: Bars(len(ids), k) for d, (ids, _) in shared.value.items()}
        held: dict[int, list[tuple]] = {d: [] for d in bars}
        count = 0

        def pruned(d: int) -> None:
            if held[d]:
                q, *rest = (np.concatenate(x) for x in zip(*held[d], strict=True))
                may = rest[-1] >= bars[d].low.min(1)[q]
                held[d] = [(q[may], *(x[may] for x in rest))]

        for batch in batches:
            for b in batch.to_pylist():
                d = b["dim"]
                if d not in bars:
                    continue
                query_ids, queries = shared.value[d]
                ids = np.frombuffer(b["ids"], dtype=np.int64)
                low, width = np.frombuffer(b["low"]), np.frombuffer(b["width"])
                cells = np.frombuffer(b["cells"], dtype=np.uint8).reshape(len(ids), d)
                for a in range(0, len(query_ids), step):
                    at = slice(a, a + step)
                    lower, upper = bounds(cells, low, width, queries[at])
                    own = ids[:, None] == query_ids[None, at]
                    lower[own] = upper[own] = -np.inf
                    c, q = np.nonzero((upper >= bars[d].add(lower, at)) & ~own)
                    held[d].append((q + a, np.full(len(c), b["block"]), c.astype(np.int32), lower[c, q], upper[c, q]))
                    count += len(c)
                if count > 1 << 19:
                    for x in held:
                        pruned(x)
                    count = 0
        for d in held:
            pruned(d)
            for q, *rest in held[d]:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][q]), *map(pa.array, rest)], names=[x.split()[0] for x in _CANDIDATE.split(", ")])

    return run


def _read(shared, k: int):
    """Blocks with their candidates (block, dim, ids, exact, asked): exact scores, in the order of the bounds, of those that may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {d: (np.argsort(ids), np.sort(ids)) for d, (ids, _) in shared.value.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column(1)[i].as_py()
                ids = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64)
                vectors = np.frombuffer(batch.column(3)[i].as_py()).reshape(len(ids), d)
                asked = batch.column(4)[i].values
                query, pos, upper = (asked.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                order, known = place[d]
                q = order[np.searchsorted(known, query)]
                by_bound = np.lexsort((-upper, q))
                q, pos, upper = q[by_bound], pos[by_bound], upper[by_bound]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                best_q, best_s, best_v = (np.zeros(0, dtype=np.int64) for _ in range(3))
                for at in range(0, int(nth.max(initial=-1)) + 1, 2 * k):  # down the bounds, until no other can count
                    now = (nth >= at) & (nth < at + 2 * k)
                    if at:
                        numbers, n = np.unique(best_q, return_counts=True)
                        kth = np.full(len(known), -np.inf)
                        last = np.cumsum(n) - 1
                        kth[numbers[n == k]] = best_s[last[n == k]].astype(np.float64) * (1 - np.sign(best_s[last[n == k]]) * 2.0**-52)
                        now[now] = upper[now] >= kth[q[now]]
                        if not now.any():
                            break
                    best_q, best_s, best_v = np.concatenate([best_q, q[now]]), np.concatenate([best_s, exact_scores(vectors[pos[now]], shared.value[d][1][q[now]])]), np.concatenate([best_v, ids[pos[now]]])
                    top = best_of(best_q, best_s, best_v, k)
                    best_q, best_s, best_v = best_q[top], best_s[top], best_v[top]
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][best_q]), pa.array(best_v), pa.array(best_s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows."""
    spark = df.sparkSession
    rows = bounded(df).where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    row = F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    file = cut(rows.select(*row).mapInArrow(_file(k), _FILE))
    asked = rows.where(is_query).select(*row).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    passes = max(1, -(-size["n"] // max(1, query_block // 2)), -(-8 * size["numbers"] // (QUERY_BYTES // 2)))  # half full on average
    asked = cut(asked.withColumn("pass", F.pmod(F.xxhash64("id"), F.lit(passes)).cast("int")).repartitionByRange("pass").sortWithinPartitions("pass"))
    path = scratch(spark)
    for number in range(passes):
        by_size: dict[int, list] = {}
        for r in asked.where(F.col("pass") == number).toLocalIterator():
            by_size.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        shared = spark.sparkContext.broadcast({d: (np.array([i for i, _ in x], dtype=np.int64), scaled(np.array([v for _, v in x], dtype=np.float64).reshape(len(x), d))) for d, x in by_size.items()})
        found = cut(file.select("block", "dim", "ids", "low", "width", "cells").mapInArrow(_scan(shared, k), _CANDIDATE))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("lower").desc()))
        bar = found.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("lower").alias("bar"))
        left = found.join(bar, "query_id", "left").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar")))
        by_block = left.groupBy("block").agg(F.collect_list(F.struct("query_id", "pos", "upper")).alias("asked"))
        read = file.select("block", "dim", "ids", "exact").join(by_block, "block").select("block", "dim", "ids", "exact", "asked")
        read.mapInArrow(_read(shared, k), "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        discard(found)
        shared.destroy()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    results = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}"""
