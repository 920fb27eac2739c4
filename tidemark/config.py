"""Configuration first: a TOML, JSON or YAML file says what a deployment is; unknown fields are an error.

```toml
root = "hdfs:///views"
checkpoint = "hdfs:///checkpoints"
program = "CREATE SOURCE bid (…); CREATE MATERIALIZED VIEW …"   # or program_file

[[streams]]
name = "bids"
kind = "files"                # or kafka: servers, topics
path = "hdfs:///landing"
default_source = "bid"
```
"""

from __future__ import annotations

import json
import tempfile
import tomllib
from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import SparkSession

from tidemark.sinks.runner import writer
from tidemark.sources import jsonl
from tidemark.streaming import driver
from tidemark.streaming.engine import Engine
from tidemark.types import DefinitionError


@dataclass
class Stream:
    name: str
    kind: str = "files"
    path: str | None = None
    default_source: str = "events"
    servers: str | None = None
    topics: str | None = None
    allowed_lateness_ms: int | None = None

    def check(self) -> None:
        if self.kind not in ("files", "kafka"):
            raise DefinitionError(f"stream {self.name}: kind is files or kafka")
        needed = ("path",) if self.kind == "files" else ("servers", "topics")
        if missing := [n for n in needed if not getattr(self, n)]:
            raise DefinitionError(f"stream {self.name} needs {', '.join(missing)}")


@dataclass
class Config:
    root: str
    checkpoint: str | None = None
    program: str | None = None
    program_file: str | None = None
    retain: int = 64
    integer_division: bool = False
    streams: list[Stream] = field(default_factory=list)

    def text(self) -> str:
        if (self.program is None) == (self.program_file is None):
            raise DefinitionError("a configuration has a program or a program_file")
        if self.program is not None:
            return self.program
        with open(self.program_file, encoding="utf-8") as f:
            return f.read()


def _built(kind: type, given: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    if not isinstance(given, dict):
        raise DefinitionError(f"{where} is a table of fields")
    if unknown := set(given) - set(known):
        raise DefinitionError(f"{where}: unknown {', '.join(sorted(unknown))}")
    if missing := [n for n, f in known.items() if n not in given and f.default is MISSING and f.default_factory is MISSING]:
        raise DefinitionError(f"{where} needs {', '.join(missing)}")
    for n, v in given.items():
        expected = {"int": int, "bool": bool, "list[Stream]": list}.get(str(known[n].type).removesuffix(" | None"), str)
        if not (isinstance(v, expected) and (expected is not int or not isinstance(v, bool))) and not (v is None and "None" in str(known[n].type)):
            raise DefinitionError(f"{where}.{n} is of type {expected.__name__}")
    return kind(**given)


def parse(text: str, kind: str) -> Config:
    if kind == "toml":
        given = tomllib.loads(text)
    elif kind == "json":
        given = json.loads(text)
    elif kind in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise DefinitionError("YAML needs the yaml package; TOML and JSON don't") from e
        given = yaml.safe_load(text)
    else:
        raise DefinitionError(f"a configuration is toml, json or yaml, not {kind!r}")
    streams = given.get("streams", []) if isinstance(given, dict) else []
    out = _built(Config, given, "the configuration")
    out.streams = [_built(Stream, s, "a stream") for s in streams]
    for s in out.streams:
        s.check()
    if len({s.name for s in out.streams}) < len(out.streams):
        raise DefinitionError("two streams have one name")
    return out


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), path.rsplit(".", 1)[-1].lower())


def dry_run(spark: SparkSession, config: Config) -> list[tuple]:
    """Define everything in a scratch folder, start nothing: the views and how they would be kept."""
    e = Engine(spark, tempfile.mkdtemp(prefix="tidemark-dry-"), config.retain, config.integer_division)
    e.run_program(config.text())
    for sink in e.sinks.values():
        writer(sink)
    for s in config.streams:
        if s.kind == "files" and s.default_source not in e.sources:
            raise DefinitionError(f"stream {s.name}: no source {s.default_source}")
    return e.describe()


def start(spark: SparkSession, config: Config, available_now: bool = False) -> tuple[Engine, list]:
    """The engine with its program, and the running queries of its streams."""
    e = Engine(spark, config.root, config.retain, config.integer_division)
    e.run_program(config.text())
    queries = []
    for s in config.streams:
        if config.checkpoint is None:
            raise DefinitionError("streams need a checkpoint")
        rows = jsonl.stream(spark, s.path, s.default_source) if s.kind == "files" else jsonl.kafka(spark, s.servers, s.topics)
        queries.append(driver.start(e, rows, s.name, f"{config.checkpoint.rstrip('/')}/{s.name}", available_now, allowed_lateness_ms=s.allowed_lateness_ms))
    return e, queries
