"""CREATE SINK carried out: each defined sink gets the versions after its cursor, again and again until they are taken.

| connector | properties |
|-|-|
| file | path |
| http | url, batch.rows |
| kafka | bootstrap.servers, topic, key |
| table | path, key |
| jdbc | url, table, key, mode (upsert or append_only), user, password, driver |
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.sinks import append_only, deliver, to_files, to_http, to_kafka, to_table, upsert_statements
from tidemark.streaming.engine import Engine
from tidemark.types import DefinitionError, SinkDef

_NEEDED = {"file": ("path",), "http": ("url",), "kafka": ("bootstrap.servers", "topic"), "table": ("path", "key"), "jdbc": ("url", "table")}
_MORE = {"file": (), "http": ("batch.rows",), "kafka": ("key",), "table": (), "jdbc": ("key", "mode", "user", "password", "driver")}
_ALL = ("connector", "format", "encode", "snapshot", "most")


def writer(sink: SinkDef) -> Callable[..., None]:
    """The function that writes a version's changes; unknown or missing properties are an error."""
    p = sink.properties
    kind = p.get("connector", "")
    if kind not in _NEEDED:
        raise DefinitionError(f"sink {sink.name}: connector is one of {', '.join(_NEEDED)}")
    if missing := [n for n in _NEEDED[kind] if n not in p]:
        raise DefinitionError(f"sink {sink.name} needs {', '.join(missing)}")
    if unknown := set(p) - {*_NEEDED[kind], *_MORE[kind], *_ALL}:
        raise DefinitionError(f"sink {sink.name}: unknown {', '.join(sorted(unknown))}")
    if kind == "file":
        return to_files(p["path"])
    if kind == "http":
        return to_http(p["url"], int(p.get("batch.rows", 500)))
    if kind == "kafka":
        return to_kafka(p["bootstrap.servers"], p["topic"], sink.view, p.get("key"))
    if kind == "table":
        return to_table(p["path"], p["key"])
    mode = p.get("mode", "upsert")
    if mode not in ("upsert", "append_only") or (mode == "upsert" and "key" not in p):
        raise DefinitionError(f"sink {sink.name}: mode is upsert, with a key, or append_only")
    return to_jdbc(p["url"], p["table"], p.get("key"), sink.name, {n: p[n] for n in ("user", "password", "driver") if n in p})


def run(engine: Engine, attempts: int = 5, wait: float = 0.5, write: Callable[[SinkDef], Callable[..., None]] = writer) -> dict[str, list[int]]:
    """One round: what each sink was given. A failing write is tried again after doubling pauses; then its error is raised,
    after the other sinks have had their turn."""
    done, failed = {}, None
    for name, sink in list(engine.sinks.items()):
        put = write(sink)
        pause = wait
        for attempt in range(1, attempts + 1):
            try:
                done[name] = deliver(engine, name, sink.view, put, int(sink.properties.get("most", 32)), sink.properties.get("snapshot", "false").lower() == "true")
                break
            except DefinitionError:
                raise
            except Exception as e:
                if attempt == attempts:
                    failed = failed or e
                else:
                    time.sleep(pause)
                    pause *= 2
    if failed:
        raise failed
    return done


def to_jdbc(url: str, table: str, key: str | None, sink: str = "sink", properties: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """A table behind JDBC: with a key its rows are replaced, without one they are only added (a removal is an error).

    A version's rows are written to a stage table by the tasks; one transaction then moves them and notes the
    version, so that a version that is written again changes nothing.
    """
    given = dict(properties or {})

    def write(changes: DataFrame, v: int) -> None:
        spark = changes.sparkSession
        jvm = spark.sparkContext._jvm
        quote = lambda n: jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(n)
        names = [c for c in changes.columns if c not in ("version", "diff", "time")]
        if key:
            rows = upsert_statements(changes, table, key).selectExpr(*[f"`{n}`" for n in names], "CAST(deleted AS INT) AS __deleted")
        else:
            rows = append_only(changes).selectExpr(*[f"`{n}`" for n in names], "0 AS __deleted", "explode(sequence(1L, diff)) AS __copy").drop("__copy")
        stage, noted = f"{table}_stage_{v}", f"{table}_versions"
        rows.write.jdbc(url, stage, "overwrite", given)
        if "driver" in given:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(given["driver"])
        login = jvm.java.util.Properties()
        for k, x in given.items():
            login.setProperty(k, x)
        c = jvm.java.sql.DriverManager.getConnection(url, login)
        try:
            c.setAutoCommit(False)
            s = c.createStatement()
            there = lambda n: c.getMetaData().getTables(None, None, n, None).next() or c.getMetaData().getTables(None, None, n.upper(), None).next()
            if not there(noted):
                s.executeUpdate(f"CREATE TABLE {noted} (sink VARCHAR(255) NOT NULL, version BIGINT NOT NULL)")
            found = s.executeQuery(f"SELECT max(version) FROM {noted} WHERE sink = '{sink.replace(chr(39), chr(39) * 2)}'")
            found.next()
            if found.getLong(1) < v:
                columns = ", ".join(map(quote, names))
                if key:
                    s.executeUpdate(f"DELETE FROM {table} WHERE {quote(key)} IN (SELECT {quote(key)} FROM {stage})")
                s.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} WHERE {quote('__deleted')} = 0")
                s.executeUpdate(f"INSERT INTO {noted} VALUES ('{sink.replace(chr(39), chr(39) * 2)}', {v})")
            c.commit()
            s.executeUpdate(f"DROP TABLE {stage}")
            c.commit()
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    return write
