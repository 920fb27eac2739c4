"""Versioned Z-sets in Parquet with one JSON manifest, published by an atomic rename.

A table is a list of layers, each a directory of weighted rows written at one version. Its snapshot
at a version is the consolidated sum of the layers up to it. A layer that is written belongs to the
table only once it is published with its version; if the tick fails before, ``rollback`` deletes it.
When more than ``COMPACT`` layers are older than all that retained versions and sinks need, their sum is
written as one new base layer and they are deleted; what came before a base can't be read any more.
Files go through Hadoop's file system, so any store that Spark can write will do.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import zset
from tidemark.types import WEIGHT, DefinitionError

COMPACT = 16


def observed(seen: Observation) -> dict | None:
    """What was counted while writing; None if it isn't told within two seconds."""
    for _ in range(200):
        if seen._jo.future().isCompleted():
            return seen.get
        time.sleep(0.01)
    return None


def _rows(layer: dict) -> int:
    return layer.get("rows") or abs(layer.get("weight") or 0)


class Store:
    def __init__(self, spark: SparkSession, root: str, retain: int = 1):
        self.spark, self.root, self.retain = spark, root.rstrip("/"), max(1, retain)
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.manifest = self._read() or {"version": 0, "tables": {}, "commits": {}, "times": {}, "cursors": {}}
        self.pending: list[tuple[str, dict]] = []

    # files
    def _read(self) -> dict | None:
        path = self._path(f"{self.root}/MANIFEST.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self) -> None:
        """Make the manifest what a restart will find; all or nothing."""
        tmp, final = self._path(f"{self.root}/.MANIFEST-{uuid.uuid4().hex}"), self._path(f"{self.root}/MANIFEST.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(tmp), context.makeQualified(final), options)

    # tables
    @property
    def version(self) -> int:
        return self.manifest["version"]

    def create(self, name: str, schema: T.StructType) -> None:
        if name not in self.manifest["tables"]:
            self.manifest["tables"][name] = {"schema": schema.jsonValue(), "layers": []}

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.manifest["tables"][name]["schema"])

    def _weighted(self, name: str) -> T.StructType:
        return T.StructType([*[T.StructField(f.name, f.dataType) for f in self.schema(name).fields], T.StructField(WEIGHT, T.LongType())])

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._weighted(name))
        return self.spark.read.schema(self._weighted(name)).parquet(*[f"{self.root}/{p}" for p in paths])

    def snapshot(self, name: str, version: int | None = None, raw: bool = False) -> DataFrame:
        """The consolidated Z-set at a version (the latest by default); ``raw``: its layers' rows as they are."""
        layers = self._layers(name, version)
        z = self._load(name, [x["path"] for x in layers])
        return z if len(layers) == 1 or raw else zset.consolidate(zset.dealt(z, self.rows(name)))

    def _layers(self, name: str, version: int | None) -> list[dict]:
        layers = self.manifest["tables"][name]["layers"]
        if version is not None:
            self.check_kept(name, version)
            layers = [x for x in layers if x["version"] <= version]
        bases = [i for i, x in enumerate(layers) if x["base"]]
        return layers[bases[-1] :] if bases else layers

    def present(self, name: str, version: int | None = None) -> DataFrame:
        """The plain rows at a version; only what few removals may meet is shuffled."""
        layers = self._layers(name, version)
        less = [x for x in layers if x.get("negative", True)]
        own, gone = sum(map(_rows, layers)), sum(x.get("gone", _rows(x)) for x in less)
        z = self._load(name, [x["path"] for x in layers])
        if len(layers) > 1 and less:
            z = zset.settle(z, self._load(name, [x["path"] for x in less]).where(F.col(WEIGHT) < 0), gone, own)
        return zset.expand(z)

    def empty(self, name: str) -> DataFrame:
        return self._load(name, [])

    def count(self, name: str, version: int | None = None) -> int | None:
        """How many rows a table has, from the manifest alone; None if a layer doesn't say."""
        if version is not None:
            self.check_kept(name, version)
        weights = [x.get("weight") for x in self.manifest["tables"][name]["layers"] if version is None or x["version"] <= version]
        return None if None in weights else sum(weights)

    def rows(self, name: str) -> int:
        """How many rows the layers of a table hold; a layer that doesn't say counts by its weight."""
        return sum(map(_rows, self.manifest["tables"][name]["layers"]))

    def only_adds(self, name: str) -> bool:
        """Whether no layer of a table takes rows away."""
        return not any(x.get("negative", True) for x in self.manifest["tables"][name]["layers"])

    def oldest(self, name: str) -> int:
        """The oldest version that can be read, and after which all deltas are still there."""
        return max([0, *(x["version"] for x in self.manifest["tables"][name]["layers"] if x["base"])])

    def check_kept(self, name: str, version: int) -> None:
        if version < self.oldest(name):
            raise DefinitionError(f"version {version} of {name} is not kept, the oldest is {self.oldest(name)}")

    def delta(self, name: str, version: int) -> DataFrame:
        return self._load(name, [x["path"] for x in self.manifest["tables"][name]["layers"] if x["version"] == version and not x["base"]])

    def versions(self, name: str) -> list[int]:
        """Versions after which the table changed and whose deltas are still there."""
        return sorted({x["version"] for x in self.manifest["tables"][name]["layers"] if not x["base"]})

    def write(self, name: str, delta: DataFrame, version: int) -> tuple[DataFrame, int, bool]:
        """Write a consolidated delta for a version that is not published yet: as written, its rows, whether any weight is negative."""
        path = f"{name}/{version}-{uuid.uuid4().hex[:8]}"
        names = [f.name for f in self.schema(name).fields]
        layer = {"version": version, "path": path, "base": False}
        self.pending.append((name, layer))
        seen = Observation()
        sums = [F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(WEIGHT) < 0, 1)).alias("gone"), F.sum(WEIGHT).alias("weight")]
        delta.select(*[f"`{n}`" for n in names], WEIGHT).observe(seen, *sums).write.parquet(f"{self.root}/{path}")
        written = self._load(name, [path])
        layer |= observed(seen) or written.agg(*sums).first().asDict()
        rows, negative = layer["rows"], layer["gone"] > 0
        layer["negative"] = negative
        if not rows:
            self.pending.pop()
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
            written = self.empty(name)
        return written, rows, negative

    def attach(self) -> None:
        """What was written becomes part of its tables; to be published with its version."""
        for name, layer in self.pending:
            self.manifest["tables"][name]["layers"].append(layer)
        self.pending.clear()

    def rollback(self) -> None:
        """Forget and delete what was written since the last publication."""
        for _, layer in self.pending:
            self._fs.delete(self._path(f"{self.root}/{layer['path']}"), True)
        self.pending.clear()

    def compact(self) -> None:
        """One base layer for the many of a table that lie before its oldest retained version and all cursors of its sinks."""
        for name, t in self.manifest["tables"].items():
            waiting = [self.manifest["cursors"].get(s, 0) for s, of in self.manifest.get("sinks", {}).items() if f"view.{of}" == name]
            oldest = min([self.version - self.retain + 1, *waiting])
            before = [x for x in t["layers"] if x["version"] <= oldest]
            if len(before) > COMPACT:
                path = f"{name}/base-{oldest}-{uuid.uuid4().hex[:8]}"
                self.snapshot(name, oldest).write.parquet(f"{self.root}/{path}")
                weights = [x.get("weight") for x in before]
                base = {"version": oldest, "path": path, "base": True, "negative": False} | ({"weight": sum(weights)} if None not in weights else {})
                t["layers"] = [base, *[x for x in t["layers"] if x["version"] > oldest]]
                least = min(self.oldest(n) for n in self.manifest["tables"])
                self.manifest["times"] = {v: x for v, x in self.manifest["times"].items() if int(v) >= least}
                self.publish()
                for x in before:
                    self._fs.delete(self._path(f"{self.root}/{x['path']}"), True)
