"""Where changes go: changelog rows as JSON lines, HTTP requests, Debezium envelopes, keyed tables.

A sink reads the deltas after its cursor, version by version, and keeps the cursor in the engine's
manifest: a version is delivered at least once, and its rows carry keys by which a receiver can drop
repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.engine import Engine


def changelog_json(changes: DataFrame) -> DataFrame:
    """``value``: each row of ``Engine.subscribe`` as JSON, the view's columns with __mv_version, __op and __time."""
    names = [c for c in changes.columns if c not in ("version", "diff", "time")]
    return changes.select(F.to_json(F.struct(*names, F.col("version").alias("__mv_version"), F.col("diff").alias("__op"), F.col("time").alias("__time")), {"ignoreNullFields": "false"}).alias("value"))


def debezium(changes: DataFrame, table: str, key: str | None = None, tombstones: bool = False) -> DataFrame:
    """key and value of change envelopes: a row that goes is a delete with its image before, one that comes a create.

    A weight of n gives n envelopes.
    """
    names = [c for c in changes.columns if c not in ("version", "diff", "time")]
    row = F.struct(*names)
    none = F.lit(None).cast(changes.select(row.alias("r")).schema["r"].dataType)
    each = changes.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("diff"))))
    gone = F.col("diff") < 0
    body = F.struct(
        F.when(gone, row).otherwise(none).alias("before"),
        F.when(~gone, row).otherwise(none).alias("after"),
        F.struct(F.lit(table).alias("table"), F.col("version")).alias("source"),
        F.when(gone, "d").otherwise("c").alias("op"),
        F.col("time").alias("ts_ms"),
    )
    keyed = F.to_json(F.struct(F.col(key))) if key else F.lit(None).cast("string")
    out = each.select(F.col("version"), F.col("diff"), keyed.alias("key"), F.to_json(F.struct(body.alias("payload")), {"ignoreNullFields": "false"}).alias("value"))
    if tombstones and key:
        out = out.unionByName(out.where("diff < 0").withColumn("value", F.lit(None).cast("string")))
    return out.select("version", "key", "value")


def deliver(engine: Engine, sink: str, view: str, write: Callable[..., None], most: int = 32, snapshot: bool = False) -> list[int]:
    """Write the deltas after the sink's cursor, at most ``most`` versions; returns those delivered.

    Deltas after the cursor are kept once the sink is defined, by CREATE SINK or a first delivery. If some
    are gone already, it is an error; ``snapshot`` lets a sink without a cursor begin with the view's rows
    at the oldest version that is kept, as that version's changes.
    """
    cursors = engine.store.manifest["cursors"]
    table = f"view.{view}"
    begin = snapshot and sink not in cursors and engine.store.oldest(table)
    if not begin:
        engine.store.check_kept(table, cursors.get(sink, 0))
    engine.add_sink(sink, view)
    done = []
    for v in [*([begin] if begin else []), *[v for v in engine.store.versions(table) if v > cursors.get(sink, 0)]][:most]:
        last = {"last": cursors.get(sink, 0)} if getattr(write, "takes_last", False) else {}
        changes = engine.subscribe(view, snapshot=v == begin, as_of=v if v == begin else v - 1)
        write(changes.where(F.col("version") == v), v, **last)
        cursors[sink] = v
        engine.store.publish()
        done.append(v)
    return done


def to_files(root: str) -> Callable[[DataFrame, int], None]:
    """JSON lines, one folder for each version; a version written again replaces itself."""
    return lambda changes, v: changelog_json(changes).write.mode("overwrite").text(f"{root}/version={v}")


def to_kafka(servers: str, topic: str, table: str, key: str | None = None) -> Callable[[DataFrame, int], None]:
    """Envelopes to a topic. Needs Spark's Kafka package on the class path."""
    return lambda changes, v: debezium(changes, table, key).select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def to_http(url: str, batch_rows: int = 500, post: Callable[[str, bytes, dict], None] | None = None, requests: int | None = None) -> Callable[[DataFrame, int], None]:
    """JSON arrays by POST from the tasks, about ``batch_rows`` rows each.

    Rows go to requests by a hash of their content, and a request's rows are sorted: however a retry is
    partitioned, request i of a version holds the same rows. ``Idempotency-Key`` is version:i:digest of
    the body, so a receiver can drop what it has had. ``requests`` fixes their number for each version.
    """

    def write(changes: DataFrame, v: int) -> None:
        lines = changelog_json(changes)
        n = requests or max(1, -(-lines.count() // batch_rows))

        def send(batches: Iterator) -> Iterator:
            import hashlib

            import pyarrow as pa

            held: list[str] = []
            at = None

            def flush() -> None:
                if held:
                    body = ("[" + ",".join(sorted(held)) + "]").encode()
                    headers = {"Content-Type": "application/json", "Idempotency-Key": f"{v}:{at}:{hashlib.sha256(body).hexdigest()}"}
                    (post or _post)(url, body, headers)
                    held.clear()

            sent = 0
            for b in batches:
                for i, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if i != at:
                        flush()
                        at = i
                    held.append(value)
                    sent += 1
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["sent"])

        numbered = lines.select(F.pmod(F.xxhash64("value"), F.lit(n)).alias("request"), "value")
        numbered.repartition("request").sortWithinPartitions("request").mapInArrow(send, "sent long").agg(F.sum("sent")).collect()

    return write


def _post(url: str, body: bytes, headers: dict) -> None:
    from urllib.request import Request, urlopen

    urlopen(Request(url, data=body, headers=headers, method="POST"), timeout=30).read()


def upsert_statements(changes: DataFrame, table: str, key: str) -> DataFrame:
    """For a keyed table behind JDBC: the last image of each key, and whether it is to be deleted."""
    names = [c for c in changes.columns if c not in ("version", "diff", "time")]
    last = changes.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*names, "diff"), F.struct("version", "diff")).alias("r"))
    return last.select("r.*").withColumn("deleted", F.col("diff") < 0).drop("diff")


def to_table(path: str, key: str) -> Callable[..., None]:
    """A keyed Parquet table, one folder for each version: the last image of each key, in the newest folder.

    The state before a version is the folder of the sink's cursor, which ``deliver`` gives (0: nothing yet);
    without one, the newest folder of an earlier version.
    """

    def write(changes: DataFrame, v: int, last: int | None = None) -> None:
        spark = changes.sparkSession
        rows = upsert_statements(changes, path, key)
        if last is None:
            last = max((x for x in _folders(spark, path) if x < v), default=0)
        if last:
            try:
                old = spark.read.parquet(f"{path}/version={last}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                raise FileNotFoundError(f"{path}/version={last}, the table before version {v}, is missing") from e
        else:
            old = rows.drop("deleted").limit(0)
        kept = old.join(rows.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        kept.unionByName(rows.where("NOT deleted").drop("deleted")).write.mode("overwrite").parquet(f"{path}/version={v}")

    write.takes_last = True
    return write


def _folders(spark: SparkSession, path: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]


def append_only(changes: DataFrame) -> DataFrame:
    """The rows to insert; a removal is an error."""
    return changes.where(F.when(F.col("diff") < 0, F.raise_error(F.lit("an append-only sink got a removal")).cast("boolean")).otherwise(F.lit(True)))


def reconcile(source_rows: int, target_rows: int, pending: int = 0) -> str:
    """ok, pending (the difference is still on its way), bounded (less than that) or drift."""
    gap = abs(source_rows - target_rows)
    if gap == 0:
        return "ok"
    return "pending" if pending and gap == pending else "bounded" if gap < pending else "drift"


