"""The engine: sources and views in, versions out.

``apply`` takes one batch of weighted rows for any number of sources and moves all views to the next
version together: deltas are written first, then the manifest is published, so a crash in between
leaves the old version, and a batch that is rejected leaves nothing. The same batch id is applied once.

A view over a join, a subquery, windows of time or a global top-N is kept in steps: hidden views hold
what lies inside it (``plans.steps``), each kept in its own way, and the view itself reads those.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import functions
from tidemark.operators import zset
from tidemark.operators.asof import asof_join
from tidemark.plans import ddl
from tidemark.plans.classify import Plan, classify, relations
from tidemark.plans.rewrite import asof, asof_joins, to_spark
from tidemark.plans.steps import Step, steps
from tidemark.streaming.state import Store, observed
from tidemark.types import WEIGHT, DefinitionError, SinkDef, SourceDef, ViewDef


MOST_IDS = 1_024
#: A delta of at least this part of what it is compared with is not looked up in that by its keys: both are dealt out by key together.
LARGE = 1 / 8
#: Bytes of files that one task of a batch reads.
TASK_BYTES = 16 << 20


def _types(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name.lower(), f.dataType.simpleString()) for f in schema.fields]


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def _size(df: DataFrame) -> int:
    """Bytes of what a query reads, as far as Spark knows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50)  # unknown is more


class Engine:
    def __init__(self, spark: SparkSession, root: str, retain: int = 64, integer_division: bool = False):
        self.spark, self.store, self.integer_division = spark, Store(spark, root, retain), integer_division
        self.sources: dict[str, SourceDef] = {}
        self.views: dict[str, ViewDef] = {}
        self.sinks: dict[str, SinkDef] = {}
        self.plans: dict[str, Plan] = {}
        self._removals: set[str] = set()  # what rows go from in this tick
        self._counts: dict[str, int] = {}  # the rows of this tick's deltas
        self._gone: dict[str, int] = {}  # those of negative weight
        self._unsure: tuple[DataFrame, Observation] | None = None  # groups of a step that its sums don't settle, and how many those are
        functions.register(spark)

    # definitions
    def run_program(self, program: str) -> list[DataFrame | list | Iterator[str] | None]:
        """All statements of a program in order; queries and SUBSCRIBE give their result."""
        return [self.execute(s) for s in ddl.statements(program)]

    def execute(self, statement: str) -> DataFrame | list | Iterator[str] | None:
        s, soft = ddl.parse(statement)
        if isinstance(s, SourceDef):
            return self.add_source(s, soft)
        if isinstance(s, ViewDef):
            return self.add_view(s, soft)
        if isinstance(s, SinkDef):
            return self.execute_sink(s)
        if isinstance(s, ddl.Replicate):  # the table as it stands is a view, whose layers are the buffer of its sink
            self.add_view(ViewDef(s.name, f"SELECT * FROM {s.table}"), soft)
            return self.execute_sink(SinkDef(s.name, s.name, s.properties))
        if isinstance(s, ddl.Subscribe):
            if s.copy:
                return self.copy_out(s.view, s.snapshot, s.as_of)
            return self.subscribe(s.view, s.snapshot, s.as_of)
        if isinstance(s, ddl.Show):
            return self.describe(s.view)
        return self.query(s.sql)

    def execute_sink(self, s: SinkDef) -> None:
        if s.view not in self.views:
            raise DefinitionError(f"no view {s.view}")
        self.sinks[s.name] = s
        self.add_sink(s.name, s.view)

    def add_source(self, s: SourceDef, soft: bool = False) -> None:
        if s.name in self.sources and soft:
            return
        if s.name in self.views:
            raise DefinitionError(f"{s.name} is a view")
        self.sources[s.name] = s
        self.store.create(f"source.{s.name}", s.schema)

    def add_view(self, v: ViewDef, soft: bool = False) -> None:
        if v.name in self.views or v.name in self.sources:
            if soft:
                return
            raise DefinitionError(f"{v.name} exists")
        sql = to_spark(v.sql, self.integer_division, keep_asof=True)
        shape = self._shape(sql)
        if len(set(shape.columns)) < len(shape.columns):
            raise DefinitionError("a view's columns need distinct names")
        if WEIGHT in shape.columns:
            raise DefinitionError(f"{WEIGHT} is reserved")
        known = dict(self.views), dict(self.plans), json.dumps(self.store.manifest["tables"])
        try:
            for step in steps(sql, v.name, self._shape, self._held):
                if step.name == v.name:
                    self._keep(ViewDef(v.name, step.sql, v.properties), step.plan)
            if _types(self.store.schema(f"view.{v.name}")) != _types(shape.schema):
                raise DefinitionError("the steps give other columns")
        except (AnalysisException, ParseException, DefinitionError):  # a query that can't be taken apart is kept as it stands
            self.views, self.plans, self.store.manifest["tables"] = known[0], known[1], json.loads(known[2])
            self.store.rollback()
            self._keep(ViewDef(v.name, sql, v.properties))

    def _held(self, step: Step) -> None:
        """A hidden view."""
        self._keep(ViewDef(step.name, step.sql), step.plan)

    def _shape(self, sql: str) -> DataFrame:
        """A query over empty sources and views."""
        empty = {n: self.spark.createDataFrame([], s.schema) for n, s in self.sources.items()} | {n: self.spark.createDataFrame([], self.store.schema(f"view.{n}")) for n in self.views}
        return self._eval(sql, empty)

    def _keep(self, v: ViewDef, plan: Plan | None = None) -> None:
        """Choose how one step is kept, and fill it with what is there already."""
        shape = self._shape(v.sql)
        read = relations(shape)
        used = [n for n in [*self.sources, *self.views] if n.lower() in read]
        columns = {c.lower() for n in used for c in self.store.schema(self._table(n)).fieldNames()}
        if plan is not None:
            plan.sources = used
        self.plans[v.name] = plan or classify(shape, v.sql, used, columns)
        self.views[v.name] = v
        known = f"view.{v.name}" in self.store.manifest["tables"]
        self.store.create(f"view.{v.name}", _nullable(shape.schema))
        if not known and (not used or self.store.version):  # constants, and views over what is there already
            rows = self._eval(v.sql, {n: zset.expand(self._state(n)) for n in used})
            version = self.store.version + 1
            self.store.write(f"view.{v.name}", zset.consolidate(zset.weighted(rows)), version)
            self._publish(version, None, None)

    def add_sink(self, name: str, view: str) -> None:
        """From now on the view's changes after the sink's cursor are kept."""
        sinks = self.store.manifest.setdefault("sinks", {})
        if sinks.get(name) != view:
            sinks[name] = view
            self.store.publish()

    def drop_sink(self, name: str) -> None:
        """Forget a sink and its cursor; changes are no longer kept for it."""
        self.sinks.pop(name, None)
        self.store.manifest.get("sinks", {}).pop(name, None)
        self.store.manifest["cursors"].pop(name, None)
        self.store.publish()

    def drop_view(self, name: str) -> None:
        own = [n for n in self.views if n == name or n.startswith(f"{name}__step")]
        for v, p in self.plans.items():
            if name in p.sources:
                raise DefinitionError(f"{v} reads {name}")
        for n in own:
            del self.views[n], self.plans[n]
            self.store.manifest["tables"].pop(f"view.{n}")
        self.store.publish()

    # evaluation
    def _eval(self, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
        return self.spark.sql(self._with_asof(sql))

    def _with_asof(self, sql: str) -> str:
        """As-of joins by windows: each becomes a relation of two structs, named like the sides, so that ``a.x`` is a field.

        What can't be read that way (columns without their relation, keys that aren't columns) becomes a lateral subquery.
        """
        if not re.search(r"\bASOF\b", sql, re.IGNORECASE):
            return sql
        whole, lateral = sql, asof(sql)
        for i, ((a, b), j) in reversed(list(enumerate(asof_joins(sql)))):
            left, right = self.spark.table(j.left), self.spark.table(j.right)
            on = [f"__key{n}" for n in range(len(j.keys))]
            pack = lambda df, keys, time, name: df.select(*[F.col(k).alias(o) for k, o in zip(keys, on, strict=True)], F.col(time).alias("__time"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
            joined = asof_join(pack(left, [k for k, _ in j.keys], j.left_time, j.left_name), pack(right, [k for _, k in j.keys], j.right_time, "r"), on, "__time", "__time", j.op, "inner" if j.inner else "left")
            joined.select(j.left_name, F.col("right_r").alias(j.right_name)).createOrReplaceTempView(f"__asof{i}")
            whole = f"{whole[:a]}__asof{i}{whole[b:]}"
        try:
            self.spark.sql(whole)
        except (AnalysisException, ParseException):
            return lateral
        return whole

    def _table(self, name: str) -> str:
        return f"source.{name}" if name in self.sources else f"view.{name}"

    def _state(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.snapshot(self._table(name), version)

    def _delta(self, view: str, deltas: dict[str, DataFrame], version: int) -> DataFrame:
        """The view's delta at a version, from those of what it reads."""
        plan, sql = self.plans[view], self.views[view].sql
        changed = [n for n in plan.sources if n in deltas]
        raw = lambda n: self.store.snapshot(self._table(n), version - 1, raw=True)
        none = {n: self.store.empty(self._table(n)) for n in plan.sources}
        plain = {n: z.drop(WEIGHT) for n, z in none.items()}

        def signed(tables: dict[str, DataFrame], w: int) -> DataFrame:
            return zset.weighted(self._eval(sql, plain | tables), w)

        if plan.mode in ("stateless", "join") and plan.weighted:  # the query with its rows' weights, and no row written out
            if plan.mode == "stateless":
                terms = [self._eval(plan.weighted, deltas)]
            else:
                a, b = plan.sources
                pairs = [(x, y) for x, y, there in ((deltas.get(a), raw(b), a in deltas), (raw(a), deltas.get(b), b in deltas), (deltas.get(a), deltas.get(b), len(changed) == 2)) if there]
                terms = [self._eval(plan.weighted, {a: x, b: y}) for x, y in pairs]
            if not self._removals & set(plan.sources) and (plan.mode == "stateless" or all(self.store.only_adds(self._table(n)) for n in plan.sources)):
                return zset.add(*terms)  # as a batch of insertions is written
            if plan.mode == "stateless":
                return zset.settle(terms[0], terms[0].where(F.col(WEIGHT) < 0), self._gone[changed[0]], self._counts[changed[0]])
            return zset.consolidate(zset.add(*terms))
        if plan.mode == "stateless" and not self._removals & set(plan.sources):
            return signed({n: zset.expand(deltas[n]) for n in changed}, 1)
        if plan.mode == "stateless":
            plus, minus = ({n: zset.parts(deltas[n])[i] for n in changed} for i in (0, 1))
            return zset.consolidate(zset.add(signed(plus, 1), signed(minus, -1)))
        if plan.mode == "join":
            terms = []
            whole = {n: zset.expand(self._state(n, version - 1)) for n in plan.sources}
            a, b = plan.sources
            for x, y in ((a, b), (b, a)):
                if x in deltas:
                    for i, w in ((0, 1), (1, -1)):
                        terms.append(signed({x: zset.parts(deltas[x])[i], y: whole[y]}, w))
            if len(changed) == 2:
                for i, w in ((0, 1), (1, -1)):
                    for j, u in ((0, 1), (1, -1)):
                        terms.append(signed({a: zset.parts(deltas[a])[i], b: zset.parts(deltas[b])[j]}, w * u))
            return zset.consolidate(zset.add(*terms))
        gone = plan.sources[0] in self._removals
        if plan.mode in ("keyed", "sums", "ranked") and not gone and not self.store.rows(self._table(plan.sources[0])):  # the first rows
            return zset.consolidate(signed({plan.sources[0]: zset.expand(deltas[plan.sources[0]])}, 1))
        if plan.mode == "sums" and (out := self._sums_at_once(view, deltas[plan.sources[0]], version)) is not None:
            return out
        if plan.mode == "sums" and not (gone and plan.extremes):
            return self._sums_delta(view, deltas[plan.sources[0]], version)
        if plan.mode == "ranked" and not gone:  # the rows that were first, and those that come
            n = plan.sources[0]
            touched = self._keyed(plan, deltas[n])
            was = zset.consolidate(self._semi_keyed(plan, self.store.snapshot(f"view.{view}", version - 1, raw=True), touched))
            old = zset.expand(was)
            return zset.diff_rows(self._eval(sql, {n: old.unionByName(zset.expand(deltas[n]))}), old)
        if plan.mode == "top":
            n = plan.sources[0]
            plus, minus = zset.parts(deltas[n])
            old = zset.expand(self._state(view, version - 1))
            if zset.semi(minus, old.distinct()).isEmpty():
                return zset.diff_rows(self._eval(sql, {n: old.unionByName(plus)}), old)
        if plan.mode == "touched":
            touched = zset.add(*[deltas[n].selectExpr(*[f"{c} AS __k{i}" for i, c in enumerate(plan.by[n])]) for n in changed]).distinct()
            was = {n: self._semi_keyed(Plan("keyed", [n], plan.by[n]), raw(n), touched) for n in plan.sources}
            before = {n: zset.consolidate(z) for n, z in was.items()}
            after = {n: zset.consolidate(zset.add(z, deltas[n])) if n in deltas else before[n] for n, z in was.items()}
        elif plan.mode in ("keyed", "ranked") and self._large(plan.sources[0], self._table(plan.sources[0])):
            n = plan.sources[0]
            if not re.search(r"\bOVER\s*\(", sql, re.IGNORECASE):  # the groups as they are after the batch, less those that the view has
                z = self._used(zset.add(raw(n), deltas[n]), sql)
                new = self._eval(sql, {n: zset.expand(z if self.store.only_adds(self._table(n)) and not gone else zset.consolidate(z))})
                return zset.diff(zset.weighted(new), self.store.snapshot(f"view.{view}", version - 1, raw=True))
            z = self._together(plan, raw(n), deltas[n])
            before, after = {n: zset.consolidate(z.where("NOT __come").drop("__come"))}, {n: zset.consolidate(z.drop("__come"))}
        elif plan.mode in ("keyed", "sums", "ranked"):
            n = plan.sources[0]
            was = self._semi_keyed(plan, raw(n), self._keyed(plan, deltas[n]))  # touched keys before anything is summed
            before, after = {n: zset.consolidate(was)}, {n: zset.consolidate(zset.add(was, deltas[n]))}
        else:
            before = {n: self._state(n, version - 1) for n in plan.sources}
            after = {n: zset.consolidate(zset.add(before[n], deltas[n])) if n in deltas else before[n] for n in plan.sources}
        old, new = (self._eval(sql, {n: zset.expand(z) for n, z in s.items()}) for s in (before, after))
        return zset.diff_rows(new, old)

    def _keyed(self, plan: Plan, z: DataFrame) -> DataFrame:
        """The keys of rows."""
        return z.selectExpr(*[f"({k}) AS __k{i}" for i, k in enumerate(plan.keys)]).distinct()

    def _semi_keyed(self, plan: Plan, z: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows that have one of the keys."""
        return zset.semi(z.selectExpr("*", *[f"({k}) AS {x}" for k, x in zip(plan.keys, keys.columns, strict=True)]), keys).drop(*keys.columns)

    def _large(self, name: str, table: str, count: int | None = None) -> bool:
        """Whether a source's delta is a large part of a table."""
        return (self._counts[name] if count is None else count) >= LARGE * self.store.rows(table)

    @staticmethod
    def _used(z: DataFrame, sql: str) -> DataFrame:
        """The columns that a query may name."""
        words = {w.lower() for w in re.findall(r"\w+", sql)}
        return z.select(*[F.col(f"`{c}`") for c in z.columns if c == WEIGHT or not c.isidentifier() or c.lower() in words]) if not re.search(r"(SELECT|,|\.)\s*\*", sql, re.IGNORECASE) else z

    def _together(self, plan: Plan, z: DataFrame, delta: DataFrame) -> DataFrame:
        """Rows of the keys that a delta touches and the delta's (``__come``), dealt out by key once: what is summed or ranked by key then isn't shuffled again."""
        both = zset.add(z.withColumn("__come", F.lit(False)), delta.withColumn("__come", F.lit(True)))
        keys = [F.expr(f"({k})") for k in plan.keys]
        return both.repartition(*keys).withColumn("__touched", F.max("__come").over(Window.partitionBy(*keys))).where("__touched").drop("__touched")

    def _deal(self, rows: int) -> None:
        """Shuffles into parts of about ``zset.TASK_ROWS`` from now on; Spark alone merges parts to one a core, of up to 64 MB compressed."""
        n = min(20_000, rows // zset.TASK_ROWS + 1)
        conf, least = self.spark.conf, "spark.sql.adaptive.coalescePartitions.minPartitionNum"
        if n > self.spark.sparkContext.defaultParallelism:
            conf.set("spark.sql.shuffle.partitions", str(max(n, self._parts)))
            conf.set(least, str(max(n, int(self._own[least] or 0))))
            own = self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
            conf.set("spark.sql.files.maxPartitionBytes", str(min(own, TASK_BYTES)))

    @contextmanager
    def _dealt(self, batch: dict[str, DataFrame]) -> Iterator[None]:
        """The session's own settings come back after a batch."""
        names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionNum", "spark.sql.files.maxPartitionBytes")
        self._own = {k: self.spark.conf.get(k, None) for k in names}
        self._parts = int(self.spark.conf.get(names[0]))  # Spark's own, if the session doesn't say
        try:
            self._deal(sum(map(_size, batch.values())) // 16)
            yield
        finally:
            for k, v in self._own.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _sums_at_once(self, view: str, delta: DataFrame, version: int) -> DataFrame | None:
        """``_sums_delta`` in one shuffle, for whole numbers and a large delta: rows that come and the view's layers are summed together.

        The layers' rows of a group cancel each other but for the last, so that their weighted sum is that row, in decimals that can't overflow.
        A group that stays while its least or greatest value goes, and nothing as far out comes, is left to ``_reread``.
        """
        plan, table = self.plans[view], f"view.{view}"
        fields = {f.name: f.dataType for f in self.store.schema(table).fields}
        keys, values = list(fields)[: len(plan.keys)], list(fields)[len(plan.keys) :]
        if not plan.rowwise or not all(isinstance(fields[v], T.IntegralType) for v in values) or not self._large(plan.sources[0], table):
            return None
        w, wide = F.col(WEIGHT), "decimal(38,0)"
        come = self._eval(plan.rowwise, {plan.sources[0]: delta}).toDF(*fields)
        rows = zset.add(self.store.snapshot(table, version - 1, raw=True).withColumn("__come", F.lit(False)), come.withColumn(WEIGHT, F.lit(1).cast("long")).withColumn("__come", F.lit(True)))
        if self.store.rows(table) >= self.store.rows(self._table(plan.sources[0])) / 2:  # groups of a row or two: sums before the shuffle would be as many, and wider
            rows = rows.repartition(*keys)
        held, aggs = ~F.col("__come"), [F.max("__come").alias("__touched")]
        plus, minus = F.col("__come") & (F.col("__n") > 0), F.col("__come") & (F.col("__n") < 0)
        gone = plan.sources[0] in self._removals
        for v in values:
            aggs += [F.sum(F.when(held, F.col(v).cast(wide) * w.cast("decimal(3,0)")) if v != "__n" else F.when(held, F.col(v) * w)).cast(fields[v]).alias(f"old_{v}")]
            if v in plan.extremes:
                best = F.min if plan.extremes[v] == "min" else F.max
                aggs += [F.sum(F.when(held & F.col(v).isNotNull(), w)).alias(f"has_{v}"), best(F.when(plus, F.col(v))).alias(f"come_{v}")]
                aggs += [best(F.when(minus, F.col(v))).alias(f"gone_{v}")] if gone else []
            else:
                aggs += [F.sum(F.when(~held, F.col(v))).cast(fields[v]).alias(f"come_{v}")]
        z = rows.groupBy(*keys).agg(*aggs).where("__touched")
        old, new, unsure = [], [], F.lit(False)
        for v in values:
            o, c = F.col(f"old_{v}"), F.col(f"come_{v}")
            if v in plan.extremes:
                o = F.when(F.col(f"has_{v}") > 0, o)
                n = (F.least if plan.extremes[v] == "min" else F.greatest)(o, c)  # nulls are passed over
                if gone:
                    g, least = F.col(f"gone_{v}"), plan.extremes[v] == "min"
                    inside, out = (g > o, c <= o) if least else (g < o, c >= o)
                    unsure = unsure | (g.isNotNull() & ~F.coalesce(inside, F.lit(False)) & ~F.coalesce(out, F.lit(False)))
            else:
                n = F.coalesce(o, F.lit(0).cast(fields[v])) + F.coalesce(c, F.lit(0).cast(fields[v]))
            old.append(o.cast(fields[v]).alias(v))
            new.append(n.cast(fields[v]).alias(v))
        pair = z.select(*keys, F.struct(*old).alias("o"), F.struct(*new).alias("n"), unsure.alias("__unsure"))
        if gone and plan.extremes:
            left, seen = F.col("__unsure") & (F.col("n.__n") != 0), Observation()
            self._unsure = pair.where(left).select(*keys, *[F.col(f"o.{v}").alias(v) for v in values]), seen
            pair = pair.observe(seen, F.count(F.when(left, 1)).alias("unsure")).where(~left)
        pair = pair.where("NOT (o <=> n)")
        each = F.explode(F.array(F.struct(F.col("o").alias("r"), F.lit(-1).cast("long").alias("w")), F.struct(F.col("n").alias("r"), F.lit(1).cast("long").alias("w"))))
        return pair.select(*keys, each.alias("e")).where("coalesce(e.r.__n, 0) <> 0").select(*keys, *[F.col(f"e.r.{v}").alias(v) for v in values], F.col("e.w").alias(WEIGHT))

    def _reread(self, view: str, deltas: dict[str, DataFrame], version: int) -> DataFrame | None:
        """The delta of the groups that ``_sums_at_once`` left, from their rows; None if there are none."""
        plan, (groups, seen) = self.plans[view], self._unsure
        got = observed(seen)
        n = groups.count() if got is None else got["unsure"]
        if not n:
            return None
        s, keys = plan.sources[0], groups.columns[: len(plan.keys)]
        rows = self._used(zset.add(self.store.snapshot(self._table(s), version - 1, raw=True), deltas[s]), self.views[view].sql)
        if zset.few(n, self.store.rows(self._table(s))):
            keyed = rows.select("*", *[F.expr(f"({k})").alias(x) for k, x in zip(plan.keys, keys, strict=True)])
            rows = zset.near(keyed, groups.select(*keys), n).where("__near").drop("__near", *keys)
        z = zset.consolidate(self._semi_keyed(plan, rows, groups.select(*keys)))
        return zset.diff_rows(self._eval(self.views[view].sql, {s: zset.expand(z)}), groups)

    def _sums_delta(self, view: str, delta: DataFrame, version: int) -> DataFrame:
        """Counts and sums of the delta's rows, added to those of the touched groups: their rows go and come."""
        plan = self.plans[view]
        names = self.store.schema(f"view.{view}").fieldNames()
        keys = names[: len(plan.keys)]
        change = self._eval(plan.weighted, {plan.sources[0]: delta}).toDF(*names)
        was = zset.semi(self.store.snapshot(f"view.{view}", version - 1, raw=True), change.select(*keys))
        old = zset.consolidate(was).drop(WEIGHT)
        by = {"min": F.min, "max": F.max}
        summed = [by.get(plan.extremes.get(n), F.sum)(n).cast(f.dataType).alias(n) for n, f in zip(names, self.store.schema(f"view.{view}").fields, strict=True) if n not in keys]
        new = old.unionByName(change).groupBy(*keys).agg(*summed).where(F.col("__n") != 0)
        return zset.diff_rows(new, old)

    # ticks
    def apply(self, batch: dict[str, DataFrame], batch_id: str | None = None, watermark: int | None = None) -> int:
        """Apply rows (weight 1) or weighted rows to sources; returns the version after it.

        An empty batch changes nothing; a batch id that was applied before is passed over.
        """
        if batch_id is not None and self._applied(str(batch_id)):
            return self.store.version
        with self._dealt(batch):
            return self._apply(batch, batch_id, watermark)

    def _apply(self, batch: dict[str, DataFrame], batch_id: str | None, watermark: int | None) -> int:
        version = self.store.version + 1
        deltas: dict[str, DataFrame] = {}
        self._removals, self._counts, self._gone = set(), {}, {}
        try:
            for name, rows in batch.items():
                s = self.sources[name]
                z = rows if WEIGHT in rows.columns else zset.weighted(rows)
                z = z.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in s.columns], WEIGHT)
                if s.primary_key is not None and WEIGHT not in rows.columns:
                    order = F.monotonically_increasing_id()
                    z = zset.upsert_delta(self._state(name), z.drop(WEIGHT).withColumn("__order", order), s.primary_key, "__order")
                plain = s.primary_key is None and WEIGHT not in rows.columns  # insertions alone needn't be summed, nor shuffled
                written, count, negative = self.store.write(f"source.{name}", z if plain else zset.consolidate(z), version)
                if negative:
                    gone = written.where(F.col(WEIGHT) < 0)
                    before = self.store.snapshot(f"source.{name}", raw=True)
                    self._deal(self.store.rows(f"source.{name}") + count)
                    n = self.store.pending[-1][1]["gone"]
                    met = zset.near(before, gone.drop(WEIGHT), n).where("__near").drop("__near") if zset.few(n, self.store.rows(f"source.{name}")) else before
                    if not self._large(name, f"source.{name}", count) or zset.may_lack(zset.add(met, gone)):
                        held = zset.semi(before, gone.drop(WEIGHT))
                        zset.check_non_negative(zset.consolidate(zset.add(held, gone)), name)
                if count:
                    deltas[name], self._counts[name], self._gone[name] = written, count, self.store.pending[-1][1]["gone"]
                    self._removals |= {name} if negative else set()
            for view, plan in self.plans.items() if deltas else ():  # in order of definition: a view reads earlier views only
                if any(n in deltas for n in plan.sources):
                    self._deal(sum(self._counts.get(n, 0) + self.store.rows(self._table(n)) for n in plan.sources))
                    self._unsure = None
                    written, count, negative = self.store.write(f"view.{view}", self._delta(view, deltas, version), version)
                    gone = self.store.pending[-1][1]["gone"] if count else 0
                    if self._unsure is not None and (again := self._reread(view, deltas, version)) is not None:
                        more, added, fewer = self.store.write(f"view.{view}", again, version)
                        gone += self.store.pending[-1][1]["gone"] if added else 0
                        written, count, negative = zset.add(written, more), count + added, negative or fewer
                    if count:
                        deltas[view], self._counts[view], self._gone[view] = written, count, gone
                        self._removals |= {view} if negative else set()
        except BaseException:
            self.store.rollback()
            raise
        if deltas or batch_id is not None:
            self._publish(version if deltas else version - 1, batch_id, watermark if deltas else None)
        if deltas:
            self.store.compact()
        return self.store.version

    def _applied(self, batch_id: str) -> bool:
        name, _, number = batch_id.rpartition(":")
        last = self.store.manifest["commits"].get(name if name and number.isdigit() else batch_id)
        return last is not None and (not (name and number.isdigit()) or int(number) <= last)

    def _commit(self, batch_id: str) -> None:
        """Ids ``query:number`` are kept as the last number of the query, others as the last ``MOST_IDS``."""
        commits = self.store.manifest["commits"]
        name, _, number = batch_id.rpartition(":")
        if name and number.isdigit():
            commits[name] = int(number)
            return
        commits[batch_id] = -1
        others = [k for k, v in commits.items() if v == -1]
        for k in others[: max(0, len(others) - MOST_IDS)]:
            del commits[k]

    def _publish(self, version: int, batch_id: str | None, watermark: int | None) -> None:
        m = self.store.manifest
        self.store.attach()
        m["version"] = version
        if batch_id is not None:
            self._commit(str(batch_id))
        if watermark is not None:
            m["times"][str(version)] = watermark
        self.store.publish()

    def replay(self, journal: Engine, after: int = 0) -> int:
        """Apply what the sources of another engine's store got after a version, batch by batch; its store is their journal.

        For sources that can't be read again, and to build new views from the beginning; kept batches only.
        """
        names = [n for n in self.sources if f"source.{n}" in journal.store.manifest["tables"]]
        for n in names:
            journal.store.check_kept(f"source.{n}", after)
        for v in sorted({v for n in names for v in journal.store.versions(f"source.{n}") if v > after}):
            at = journal.store.manifest["times"].get(str(v))
            self.apply({n: journal.store.delta(f"source.{n}", v) for n in names if v in journal.store.versions(f"source.{n}")}, f"replay:{v}", at)
        return self.store.version

    def needed(self, source: str) -> set[str]:
        """The columns of a source that the views' scans of it read, by Spark's physical plans over empty folders."""
        out: set[str] = set()
        for v, p in self.plans.items():
            if source not in p.sources:
                continue
            tables = {}
            for n in p.sources:
                folder = f"{self.store.root}/.empty/{n}"
                self.store._fs.mkdirs(self.store._path(folder))
                tables[n] = self.spark.read.schema(_nullable(self.store.schema(self._table(n)))).parquet(folder)
            plan = self._eval(self.views[v].sql, tables)._jdf.queryExecution().executedPlan()
            plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
            leaves = plan.collectLeaves()
            for i in range(leaves.size()):
                scan = leaves.apply(i)
                if scan.nodeName().startswith("Scan parquet") and scan.relation().location().rootPaths().toString().endswith(f"/.empty/{source})"):
                    out |= set(scan.requiredSchema().fieldNames())
        return out

    # reading
    def view(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a view at a version."""
        if version is not None and not 0 <= version <= self.store.version:
            raise DefinitionError(f"no version {version}")
        return self.store.present(f"view.{name}", version)

    def query(self, sql: str, version: int | None = None, args: dict | None = None) -> DataFrame:
        """Any SELECT over views and sources. ``WHERE __mv_version = n`` selects a version."""
        if m := re.search(r"\s*(?:\bAND\s+)?\b__mv_version\s*=\s*(\d+)(\s+AND\b)?", sql, re.IGNORECASE):
            version = int(m[1])
            sql = sql[: m.start()] + " " + ("TRUE AND" if m[2] else "AND TRUE" if re.match(r"\s*AND\b", m[0], re.IGNORECASE) else "TRUE") + " " + sql[m.end() :]
        if (m := re.fullmatch(r"\s*SELECT\s+count\s*\(\s*(?:\*|1)\s*\)(?:\s+(?:AS\s+)?(\w+))?\s+FROM\s+(\w+)(?:\s+WHERE\s+TRUE)?\s*;?\s*", sql, re.IGNORECASE)) and m[2].lower() in {*self.views, *self.sources}:
            n = self.store.count(self._table(m[2].lower()), version)  # no row is read
            if n is not None:
                return self.spark.createDataFrame([(n,)], T.StructType([T.StructField(m[1] or "count(1)", T.LongType())]))
        at = F.lit(self.store.version if version is None else version).cast("long").alias("__mv_version")
        for n in self.views:
            if "__step" not in n and re.search(rf"\b{re.escape(n)}\b", sql, re.IGNORECASE):
                rows = self.view(n, version)
                (rows.select("*", at) if "__mv_version" in sql else rows).createOrReplaceTempView(n)
        for n in self.sources:
            if re.search(rf"\b{re.escape(n)}\b", sql, re.IGNORECASE):
                self.store.present(f"source.{n}", version).createOrReplaceTempView(n)
        return self.spark.sql(self._with_asof(to_spark(sql, self.integer_division, keep_asof=True)), args=args)

    def describe(self, name: str | None = None) -> list[tuple]:
        """(view, mode, version) of all views, or (column, type) of one."""
        if name is None:
            return [(n, self.mode(n), self.store.version) for n in self.views if "__step" not in n]
        if name not in self.views:
            raise DefinitionError(f"no view {name}")
        return [(f.name, f.dataType.simpleString()) for f in self.store.schema(f"view.{name}").fields]

    def mode(self, name: str) -> str:
        """How a view is kept: the modes of its steps, innermost first."""
        own = [n for n in self.views if n.startswith(f"{name}__step")]
        return " > ".join(self.plans[n].mode for n in [*own, name])

    def explain(self, name: str) -> str:
        """A view's steps: how each is kept, what it reads, its query, and Spark's plan of it over empty tables."""
        if name not in self.views:
            raise DefinitionError(f"no view {name}")
        out = []
        for n in [*(x for x in self.views if x.startswith(f"{name}__step")), name]:
            p = self.plans[n]
            plan = self._shape(self.views[n].sql)._jdf.queryExecution().optimizedPlan().toString()
            out.append(f"{n}: {p.mode} over {', '.join(p.sources) or 'nothing'}" + (f" by {', '.join(p.keys)}" if p.keys else "") + f"\n{self.views[n].sql}\n{plan}")
        return "\n".join(out)

    def subscribe(self, name: str, snapshot: bool = False, as_of: int | None = None) -> DataFrame:
        """version, diff, time and the view's columns: a snapshot if asked for, then each later delta.

        Without a snapshot and ``as_of``, all deltas from the first; an error if some are no longer kept.
        """
        table = f"view.{name}"
        if name not in self.views:
            raise DefinitionError(f"no view {name}")
        start = self.store.version if as_of is None and snapshot else as_of if as_of is not None else 0
        if start > self.store.version:
            raise DefinitionError(f"no version {start}")
        self.store.check_kept(table, start)
        times = self.store.manifest["times"]

        def shaped(z: DataFrame, v: int) -> DataFrame:
            time = F.lit(times.get(str(v))).cast("long").alias("time")
            return z.select(F.lit(v).cast("long").alias("version"), F.col(WEIGHT).alias("diff"), time, *zset.value_columns(z))

        out = [shaped(self.store.snapshot(table, start), start)] if snapshot else []
        out += [shaped(self.store.delta(table, v), v) for v in self.store.versions(table) if v > start]
        return zset.add(*out) if out else shaped(self.store.empty(table), start)

    def copy_out(self, name: str, snapshot: bool = False, as_of: int | None = None) -> Iterator[str]:
        """The changelog as lines of COPY text: tabs, ``\\N`` for null, escapes."""
        changes = self.subscribe(name, snapshot, as_of)
        esc = lambda v: "\\N" if v is None else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
        for r in changes.orderBy("version", *changes.columns[3:], "diff").toLocalIterator():
            yield "\t".join(map(esc, r))
