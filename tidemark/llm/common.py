"""What the corpus operators share: reading tables, the shared scratch folder, Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = 4 << 20
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, by Spark's own reader, so any store that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``.

    Only where a local session (as in tests) names none is a temporary folder set; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # the driver's cleaner then removes the shuffle files that led here
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``cut`` wrote, once all that reads it has been written itself."""
    for df in written:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows Spark passes to Python in Arrow batches of about ``ARROW_BYTES`` (one row at least), not of 10,000 rows.

    A limit that the session has set itself stays.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each holds about ``most`` bytes of text at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < n:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Give freed memory back to the system at the end of a task: Spark keeps the Python worker for other work."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def few_arenas() -> None:
    """Let all threads of a Python worker allocate from two heaps: the default is eight for each core, each of which keeps what is freed."""
    import ctypes

    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-8, 2)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by the first ``keys`` columns, in tables that never divide a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        last = [b.column(i)[n - 1] for i in range(keys)]
        same = n
        while same and all(b.column(i)[same - 1] == last[i] for i in range(keys)):
            same -= 1
        if same or (held and any(held[-1].column(i)[held[-1].num_rows - 1] != last[i] for i in range(keys))):
            ready = [*held, b.slice(0, same)] if same else held
            held = [b.slice(same)] if same else [b]
            yield pa.Table.from_batches(ready)
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
