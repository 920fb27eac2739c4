"""Structured Streaming in front of the engine: each micro-batch is one tick.

All sources of a query travel in one stream of (source, payload), so that a tick sees them at one
version. Watermarks: each source's greatest event time; the least over the sources that are not idle
is the global one, which never goes back.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import cdc
from tidemark.sources.jsonl import decode
from tidemark.streaming.engine import Engine


@dataclass
class Watermarks:
    """Milliseconds; ``idle_after`` seconds without rows a source no longer holds the others back.

    ``Ticker`` keeps them in the engine's manifest, so that a restart doesn't let late rows in again.
    """

    idle_after: float | None = None
    seen: dict[str, int] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)
    value: int | None = None

    def update(self, source: str, event_time: int | None, now: float | None = None) -> None:
        if event_time is not None:
            self.seen[source] = max(self.seen.get(source, event_time), event_time)
            self.last[source] = time.monotonic() if now is None else now

    def current(self, sources: list[str], now: float | None = None) -> int | None:
        now = time.monotonic() if now is None else now
        live = [s for s in sources if self.idle_after is None or now - self.last.get(s, now) <= self.idle_after]
        if live and all(s in self.seen for s in live):
            low = min(self.seen[s] for s in live)
            self.value = low if self.value is None else max(self.value, low)
        return self.value


class Ticker:
    """A ``foreachBatch`` function for streams of (source string, payload string).

    ``prune``: columns that no view reads are neither parsed nor stored, but null; a view that is defined later won't find them.
    """

    def __init__(self, engine: Engine, name: str, watermarks: Watermarks | None = None, allowed_lateness_ms: int | None = None, prune: bool = False):
        self.engine, self.name, self.marks, self.lateness, self.prune = engine, name, watermarks or Watermarks(), allowed_lateness_ms, prune
        kept = engine.store.manifest.get("watermarks", {}).get(name)
        if kept and not self.marks.seen:
            self.marks.seen, self.marks.value = dict(kept["seen"]), kept["value"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        before = dict(self.marks.seen), dict(self.marks.last), self.marks.value
        try:
            present = {r["source"] for r in batch.select("source").distinct().limit(len(self.engine.sources) + 1).collect()}
            tables = {}
            for s, definition in self.engine.sources.items():  # tables that a source's change data feeds
                if (feed := definition.properties.get("cdc_source")) in present:
                    rows = batch.where(F.col("source") == feed)
                    tables[s] = cdc.table_delta(self.engine._state(s), rows, "payload", definition, definition.properties.get("cdc_table"), self.engine.store.manifest.get("positions", {}).get(s))
            fed = {d.properties.get("cdc_source") for d in self.engine.sources.values()}
            for s in sorted((present - fed) & set(self.engine.sources)):
                definition = self.engine.sources[s]
                only = {*self.engine.needed(s), definition.event_time, definition.primary_key} if self.prune else None
                rows = decode(batch.where(F.col("source") == s), "payload", definition, only=only)
                at = definition.event_time
                if at:
                    ms = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{at}`)")
                    if self.lateness is not None and self.marks.value is not None:
                        rows = rows.where(ms >= self.marks.value - self.lateness)
                    self.marks.update(s, rows.agg(F.max(ms).alias("m")).first()["m"])
                tables[s] = rows
            now = self.marks.current(sorted(self.engine.sources))
            self.engine.store.manifest.setdefault("watermarks", {})[self.name] = {"seen": dict(self.marks.seen), "value": self.marks.value}
            self.engine.apply(tables, batch_id=f"{self.name}:{batch_id}", watermark=now)
        except BaseException:  # the batch comes again: its rows mustn't be late then
            self.marks.seen, self.marks.last, self.marks.value = before
            raise
        finally:
            batch.unpersist()


def start(engine: Engine, stream: DataFrame, name: str, checkpoint: str, available_now: bool = False, **options):
    """Start the stream of (source, payload); returns Spark's StreamingQuery."""
    writer = stream.writeStream.foreachBatch(Ticker(engine, name, **options)).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
