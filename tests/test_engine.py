from __future__ import annotations

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import zset
from tidemark.plans import ddl
from tidemark.plans.rewrite import to_spark
from tidemark.plans.sqltext import clauses, statements
from tidemark.sinks import changelog_json, debezium, deliver, reconcile, to_files, to_table
from tidemark.sources import auctions, cdc, jsonl
from tidemark.streaming import driver, state
from tidemark.streaming.engine import Engine
from tidemark.types import WEIGHT, Column, DefinitionError, SourceDef, sql_type


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sums(spark, path):
    e = Engine(spark, str(path))
    e.run_program("CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE MATERIALIZED VIEW total AS SELECT CAST(sum(price) AS BIGINT) AS s FROM bids HAVING count(*) > 0")
    return e


def test_insert_restart_retract(spark, tmp_path):
    e = sums(spark, tmp_path / "s")
    bid = lambda *p: spark.createDataFrame([(1, x) for x in p], "auction long, price long")
    e.apply({"bids": bid(10, 20, 5)})
    assert e.apply({"bids": bid(7)}) == 2
    assert rows(e.view("total")) == [(42,)]
    e = sums(spark, tmp_path / "s")  # a restart finds the state
    assert rows(e.view("total")) == [(42,)]
    e.apply({"bids": zset.weighted(bid(7), -1)})
    assert rows(e.view("total")) == [(35,)]
    assert rows(e.store.delta("view.total", 3)) == [(35, 1), (42, -1)]
    assert rows(e.view("total", 2)) == [(42,)]  # time travel
    assert rows(e.query("SELECT s FROM total WHERE __mv_version = 1")) == [(35,)]
    with pytest.raises(zset.NegativeWeight):
        e.apply({"bids": zset.weighted(bid(999), -1)})
    assert e.store.version == 3


def test_batches_are_applied_once_and_empty_ones_change_nothing(spark, tmp_path):
    e = sums(spark, tmp_path / "s")
    b = spark.createDataFrame([(1, 4)], "auction long, price long")
    assert [e.apply({"bids": b}, batch_id="q:0"), e.apply({"bids": b}, batch_id="q:0"), e.apply({"bids": b.limit(0)}, batch_id="q:1")] == [1, 1, 1]
    assert rows(e.view("total")) == [(4,)]


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    e = sums(spark, tmp_path / "s")
    b = spark.createDataFrame([(1, 4)], "auction long, price long")
    e.apply({"bids": b}, batch_id="0")
    monkeypatch.setattr(e, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        e.apply({"bids": b}, batch_id="1")
    e = sums(spark, tmp_path / "s")
    assert rows(e.view("total")) == [(4,)]
    e.apply({"bids": b}, batch_id="1")
    assert rows(e.view("total")) == [(8,)]


def test_subscribe_copy_and_sinks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE TABLE t (id BIGINT PRIMARY KEY, note VARCHAR); CREATE MATERIALIZED VIEW v AS SELECT id, note FROM t; CREATE SINK f FROM v WITH (connector = 'file', path = 'x') FORMAT PLAIN ENCODE JSON")
    put = lambda *r: e.apply({"t": spark.createDataFrame(list(r), "id long, note string")})
    put((1, "a"), (2, None))
    put((1, "b\tc"))  # the key's row is replaced
    assert rows(e.view("v")) == [(1, "b\tc"), (2, None)]
    changes = e.execute("SUBSCRIBE v")
    assert sorted((r.version, r.diff, r.id, r.note) for r in changes.collect() if r.id == 1) == [(1, 1, 1, "a"), (2, -1, 1, "a"), (2, 1, 1, "b\tc")]
    assert sorted((r.version, r.diff) for r in e.execute("SUBSCRIBE v WITH SNAPSHOT AS OF 1").collect()) == [(1, 1), (1, 1), (2, -1), (2, 1)]
    assert list(e.execute("COPY (SUBSCRIBE v WITH SNAPSHOT) TO STDOUT")) == ["2\t1\t\\N\t1\tb\\tc", "2\t1\t\\N\t2\t\\N"]
    with pytest.raises(DefinitionError):
        e.execute("SUBSCRIBE v AS OF 9")
    assert deliver(e, "f", "v", to_files(str(tmp_path / "out"))) == [1, 2]
    assert deliver(e, "f", "v", to_files(str(tmp_path / "out"))) == []
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((g["__mv_version"], g["__op"], g["id"]) for g in got) == [(1, 1, 1), (1, 1, 2), (2, -1, 1), (2, 1, 1)]
    deliver(e, "k", "v", to_table(str(tmp_path / "table"), "id"))
    assert rows(spark.read.parquet(str(tmp_path / "table/version=2"))) == [(1, "b\tc"), (2, None)]
    env = [(r.key, json.loads(r.value)["payload"]["op"]) for r in debezium(changes.where("version = 2"), "v", "id").collect()]
    assert sorted(env) == [('{"id":1}', "c"), ('{"id":1}', "d")]
    assert {"__mv_version", "__op", "__time", "id", "note"} == set(json.loads(changelog_json(changes).first().value))
    assert e.execute("SHOW MATERIALIZED VIEWS") == [("v", "stateless", 2)]
    assert e.execute("DESCRIBE MATERIALIZED VIEW v") == [("id", "bigint"), ("note", "string")]
    assert [reconcile(5, 5), reconcile(5, 4, 1), reconcile(5, 4, 2), reconcile(5, 3, 1)] == ["ok", "pending", "bounded", "drift"]


def test_a_keyed_table_keeps_its_rows_over_ticks_of_other_sources(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE TABLE t (id BIGINT PRIMARY KEY, note VARCHAR); CREATE SOURCE u (x BIGINT); CREATE MATERIALIZED VIEW v AS SELECT id, note FROM t")
    put = lambda *r: e.apply({"t": spark.createDataFrame(list(r), "id long, note string")})
    put((1, "a"), (2, "b"))
    e.apply({"u": spark.createDataFrame([(1,)], "x long")})  # the view has no version 2
    put((2, "c"), (3, "d"))
    path, want = str(tmp_path / "table"), [(1, "a"), (2, "c"), (3, "d")]
    assert deliver(e, "k", "v", to_table(path, "id")) == [1, 3]
    assert rows(spark.read.parquet(f"{path}/version=3")) == want
    to_table(path, "id")(e.subscribe("v", as_of=2), 3)  # without a cursor, and again
    assert rows(spark.read.parquet(f"{path}/version=3")) == want
    put((4, "e"))
    shutil.rmtree(f"{path}/version=3")
    with pytest.raises(FileNotFoundError):
        deliver(e, "k", "v", to_table(path, "id"))
    assert e.store.manifest["cursors"]["k"] == 3


def test_compaction_keeps_what_sinks_wait_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT", 2)
    e = Engine(spark, str(tmp_path / "s"), retain=2)
    e.run_program("CREATE SOURCE t (id BIGINT, note VARCHAR); CREATE MATERIALIZED VIEW v AS SELECT id, note FROM t; CREATE MATERIALIZED VIEW w AS SELECT id FROM t; CREATE SINK f FROM v WITH (connector = 'file', path = 'x') FORMAT PLAIN ENCODE JSON")
    put = lambda i: e.apply({"t": spark.createDataFrame([(i, "n")], "id long, note string")})
    for i in range(1, 7):
        put(i)
    ids = lambda p: sorted(json.loads(r.value)["id"] for r in spark.read.text(str(p)).collect())
    assert e.store.oldest("view.v") == 0 and e.store.oldest("view.w") > 1
    assert deliver(e, "f", "v", to_files(str(tmp_path / "f")), most=4) == [1, 2, 3, 4]
    put(7)
    assert e.store.oldest("view.v") == 4  # the cursor, though versions 6 and 7 are all that is retained
    assert deliver(e, "f", "v", to_files(str(tmp_path / "f"))) == [5, 6, 7] and ids(tmp_path / "f") == [1, 2, 3, 4, 5, 6, 7]
    old = e.store.oldest("view.w")
    assert rows(e.view("w", old)) == [(i,) for i in range(1, old + 1)]
    for gone in (lambda: e.view("w", old - 1), lambda: e.subscribe("w"), lambda: e.subscribe("w", as_of=old - 1), lambda: deliver(e, "late", "w", to_files(str(tmp_path / "g")))):
        with pytest.raises(DefinitionError):
            gone()
    assert "late" not in e.store.manifest["sinks"]
    assert rows(e.subscribe("w", as_of=7)) == []
    assert deliver(e, "late", "w", to_files(str(tmp_path / "g")), snapshot=True) == list(range(old, 8)) and ids(tmp_path / "g") == [1, 2, 3, 4, 5, 6, 7]
    e.drop_sink("f")
    put(8)
    assert e.store.oldest("view.v") == 7


def test_views_on_views_and_late_definitions(spark, tmp_path):
    e = sums(spark, tmp_path / "s")
    e.apply({"bids": spark.createDataFrame([(1, 4), (2, 6), (1, 1)], "auction long, price long")})
    e.execute("CREATE MATERIALIZED VIEW per AS SELECT auction, count(*) AS n FROM bids GROUP BY auction")
    e.execute("CREATE MATERIALIZED VIEW busy AS SELECT n, count(*) AS auctions FROM per GROUP BY n")
    assert rows(e.view("busy")) == [(1, 1), (2, 1)]
    e.apply({"bids": spark.createDataFrame([(2, 9)], "auction long, price long")})
    assert rows(e.view("busy")) == [(2, 2)]
    e.execute("CREATE MATERIALIZED VIEW two AS SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS x(k, v)")
    assert rows(e.view("two")) == [(1, "a"), (2, "b")]
    with pytest.raises(DefinitionError):
        e.drop_view("per")
    e.drop_view("busy")
    assert [v[0] for v in e.describe()] == ["total", "per", "two"]


def test_random_changes_equal_recomputation(spark, tmp_path):
    import random

    r = random.Random(4)
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE a (k BIGINT, v BIGINT) WITH (append_only = 'false'); CREATE SOURCE b (k BIGINT, w BIGINT) WITH (append_only = 'false')")
    views = {
        "j": "SELECT a.k, a.v, b.w FROM a JOIN b ON a.k = b.k",
        "g": "SELECT k, count(*) AS n, min(v) AS m, count(DISTINCT v) AS d FROM a GROUP BY k",
        "x": "SELECT DISTINCT v FROM a",
        "o": "SELECT a.k, b.w FROM a FULL JOIN b ON a.k = b.k",
    }
    for n, sql in views.items():
        e.execute(f"CREATE MATERIALIZED VIEW {n} AS {sql}")
    have = {"a": [], "b": []}
    for _ in range(3):
        batch = {}
        for s in have:
            add = [(r.choice([None, 1, 2, 3]), r.randrange(3)) for _ in range(r.randrange(1, 8))]
            gone = [have[s].pop(r.randrange(len(have[s]))) for _ in range(r.randrange(0, len(have[s]) + 1))]
            have[s] += add
            batch[s] = spark.createDataFrame([(*x, 1) for x in add] + [(*x, -1) for x in gone], f"k long, {'v' if s == 'a' else 'w'} long, {WEIGHT} long")
        e.apply(batch)
        spark.createDataFrame(have["a"], "k long, v long").createOrReplaceTempView("a")
        spark.createDataFrame(have["b"], "k long, w long").createOrReplaceTempView("b")
        want = {n: rows(spark.sql(sql)) for n, sql in views.items()}
        assert {n: rows(e.view(n)) for n in views} == want


def test_stream_of_json_lines(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE bid (auction BIGINT NOT NULL, at TIMESTAMP, amount DECIMAL(10, 2)); CREATE SOURCE person (id BIGINT); CREATE MATERIALIZED VIEW n AS SELECT auction, count(*) AS n FROM bid GROUP BY auction")
    (land / "1.json").write_text('{"auction": 1, "at": 1500, "amount": "1.5", "more": 2}\n\n[{"auction": 1}, {"auction": 2, "amount": 3}]\n{"source": "person", "data": {"id": 7}}\n')
    for _ in range(2):  # the second start finds nothing new
        q = driver.start(e, jsonl.stream(spark, str(land), "bid"), "q", str(tmp_path / "c"), available_now=True)
        q.awaitTermination()
    assert rows(e.view("n")) == [(1, 2), (2, 1)]
    assert rows(e.query("SELECT id FROM person")) == [(7,)]
    assert (dt.datetime(1970, 1, 1, 0, 0, 1, 500000),) in [(x.at,) for x in e.query("SELECT at FROM bid").collect()]
    bad = spark.createDataFrame([('{"at": 1}',)], "p string")
    with pytest.raises(Exception, match="auction is missing"):
        jsonl.decode(bad, "p", e.sources["bid"]).collect()


def test_watermarks():
    w = driver.Watermarks(idle_after=10)
    w.update("a", 100, now=0)
    assert w.current(["a", "b"], now=1) is None
    w.update("b", 50, now=1)
    assert w.current(["a", "b"], now=2) == 50
    w.update("b", 40, now=3)
    assert w.current(["a", "b"], now=3) == 50  # never back
    w.update("a", 300, now=20)
    assert w.current(["a", "b"], now=20) == 300  # b is idle


def test_change_data(spark):
    s = SourceDef("t", [Column("id", sql_type("BIGINT")), Column("v", sql_type("TEXT"))], primary_key="id")
    lines = ['{"payload": {"op": "c", "after": {"id": 1, "v": "a"}}}', '{"op": "u", "before": {"id": 1, "v": "a"}, "after": {"id": 1, "v": "b"}}', '{"op": "d", "before": {"id": 1, "v": "b"}}', None]
    z = cdc.envelopes(spark.createDataFrame([(x,) for x in lines], "p string"), "p", s)
    assert zset.consolidate(z).count() == 0
    with pytest.raises(Exception, match="truncate"):
        cdc.envelopes(spark.createDataFrame([('{"op": "t"}',)], "p string"), "p", s).collect()
    state = zset.weighted(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"))
    changes = spark.createDataFrame([(1, None, "update", 1, 1, ["v"]), (2, "x", "update", 2, 2, None), (2, None, "delete", 3, 2, None), (9, None, "update", 4, 3, ["v"]), (7, "n", "insert", 5, None, None)], "id long, v string, op string, lsn long, old_key long, __unchanged array<string>")
    after = zset.expand(zset.consolidate(zset.add(state, cdc.apply_changes(state, changes, "id"))))
    assert rows(after) == [(1, "a"), (7, "n"), (9, "c")]
    old = s.schema
    new = T.StructType([*old.fields, T.StructField("w", T.LongType())])
    assert [cdc.schema_change(old, old), cdc.schema_change(old, new), cdc.schema_change(new, old)] == ["unchanged", "compatible_addition", "incompatible"]
    assert cdc.admit(old, new, "apply_compatible_additions") == new and cdc.admit(old, new, "ignore_compatible") == old
    with pytest.raises(ValueError):
        cdc.admit(old, new, "fail_fast")


def test_statements():
    assert statements("a; b ';' -- c;\n; /* ; */ d") == ["a", "b ';'", "d"]
    s, soft = ddl.parse("CREATE SOURCE IF NOT EXISTS bid (auction INT NOT NULL, \"dateTime\" TIMESTAMP, p NUMERIC(10, 2)) WITH (connector = 'kafka', topic = 'b') FORMAT PLAIN ENCODE JSON")
    assert soft and s.name == "bid" and s.properties == {"connector": "kafka", "topic": "b", "format": "plain", "encode": "json"} and s.event_time == "dateTime"
    t, _ = ddl.parse("CREATE TABLE o (id BIGINT, v TEXT, PRIMARY KEY (id)) FROM pg TABLE 'public.o'")
    assert t.primary_key == "id" and t.properties["cdc_table"] == "public.o" and not t.append_only
    for bad in ("CREATE TABLE o (id BIGINT)", "CREATE SOURCE s (a FLOAT)", "CREATE SOURCE s (a INT, a INT)", "DROP TABLE x", "CREATE SOURCE s (a INT DEFAULT 1)", "CREATE SOURCE s (a DECIMAL(39, 1))", "INSERT INTO t VALUES (1)"):
        with pytest.raises(DefinitionError):
            ddl.parse(bad)
    assert ddl.parse("COPY (SUBSCRIBE v AS OF 3) TO STDOUT")[0] == ddl.Subscribe("v", False, 3, True)
    assert clauses("SELECT a, (SELECT 1 FROM x) FROM t GROUP BY a")["GROUP"] == "a"


def test_rewrites(spark):
    assert to_spark("SELECT a / 2, '/' FROM \"T\"", integer_division=True) == "SELECT a  div  2, '/' FROM `T`"
    assert "window(ts, '10000 milliseconds', '2000 milliseconds').start" in to_spark("SELECT count(*) FROM b GROUP BY HOP(ts, 2000, 10000)")
    spark.sql("SELECT * FROM VALUES (1, 10), (2, 20) AS t(k, t)").createOrReplaceTempView("l")
    spark.sql("SELECT * FROM VALUES (1, 5, 'a'), (1, 10, 'b'), (1, 11, 'c') AS t(k, t, v)").createOrReplaceTempView("r")
    got = spark.sql(to_spark("SELECT l.k, r.v FROM l ASOF JOIN r MATCH_CONDITION (l.t >= r.t) ON l.k = r.k"))
    assert rows(got) == [(1, "b"), (2, None)]
    with pytest.raises(DefinitionError):
        to_spark("SELECT * FROM l ASOF JOIN r MATCH_CONDITION (l.t >= r.t) USING (k)")


def test_auction_stream(spark):
    b, a, p = auctions.bids(spark, 23_456), auctions.auctions(spark, 3_000), auctions.persons(spark, 2_500)
    assert b.where("auction % 123 = 0").count() == 81 * 2 + 3_456 // 123
    assert a.select("category").distinct().count() == 10 and p.where("state = 'or'").count() == 2_500 // 6
    first = b.orderBy("bidder").first()
    assert (first.auction, first.bidder, first.price, first.channel, first.date_time) == (1, 10_001, 1_001, "apple", dt.datetime(2023, 11, 14, 22, 13, 20, 1000))
    assert b.groupBy("auction", "bidder").agg(F.count("*")).count() == 23_456


def pairs(spark, *p):
    return spark.createDataFrame(list(p), "auction long, price long")


def test_a_rejected_batch_leaves_nothing(spark, tmp_path):
    e = sums(spark, tmp_path / "s")
    e.apply({"bids": pairs(spark, (1, 10))})
    folders = set((tmp_path / "s").rglob("*.parquet"))
    with pytest.raises(zset.NegativeWeight):
        e.apply({"bids": zset.weighted(pairs(spark, (9, 5)), -1)})
    assert set((tmp_path / "s").rglob("*.parquet")) == folders
    e.apply({"bids": pairs(spark, (2, 7))})
    e.apply({"bids": pairs(spark, (9, 5))})
    assert rows(e.view("total")) == [(22,)]
    assert rows(zset.expand(sums(spark, tmp_path / "s").store.snapshot("source.bids"))) == [(1, 10), (2, 7), (9, 5)]


def test_bases_are_written_only_for_old_layers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT", 2)
    e = Engine(spark, str(tmp_path / "s"), retain=3)
    e.run_program("CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE MATERIALIZED VIEW v AS SELECT auction, price FROM bids")
    bases = []
    for i in range(8):
        e.apply({"bids": pairs(spark, (i, i))})
        bases.append(next((x["version"] for x in e.store.manifest["tables"]["view.v"]["layers"] if x["base"]), None))
    assert bases == [None] * 4 + [3, 3, 5, 5]
    assert len(rows(e.view("v"))) == 8 and len(rows(e.view("v", 6))) == 6


def test_commits_are_bounded_and_watermarks_survive(spark, tmp_path):
    e = sums(spark, tmp_path / "s")
    for i in range(4):
        assert e.apply({"bids": pairs(spark, (1, i))}, f"q:{i}") == i + 1
    assert e.apply({"bids": pairs(spark, (1, 9))}, "q:2") == 4 and e.store.manifest["commits"] == {"q": 3}
    e.run_program("CREATE SOURCE times (at TIMESTAMP, n BIGINT)")
    line = lambda at, n: (("times"), json.dumps({"at": at, "n": n}))
    batch = lambda *r: spark.createDataFrame(list(r), "source string, payload string")
    one = driver.Ticker(e, "s", allowed_lateness_ms=0)
    one.marks.update("bids", 10**15)
    one(batch(line(5_000, 1)), 0)
    again = driver.Ticker(e, "s", allowed_lateness_ms=0)
    assert again.marks.value == 5_000
    again(batch(line(4_000, 2), line(6_000, 3)), 1)
    assert [r.n for r in zset.expand(e.store.snapshot("source.times")).orderBy("n").collect()] == [1, 3]


def test_http_requests_repeat_whatever_the_partitions(spark, tmp_path):
    e = sums(spark, tmp_path / "s")
    e.run_program("CREATE MATERIALIZED VIEW v AS SELECT auction, price FROM bids")
    e.apply({"bids": pairs(spark, *((i, i) for i in range(60)))})
    changes = e.subscribe("v")
    sent = []
    for parts in (1, 5):
        folder = tmp_path / f"sent{parts}"
        folder.mkdir()

        def post(url, body, headers, folder=str(folder)):
            name = headers["Idempotency-Key"].replace(":", "_")
            with open(f"{folder}/{name}", "wb") as f:
                f.write(body)

        from tidemark.sinks import to_http

        to_http("http://x", 7, post)(changes.repartition(parts), 1)
        sent.append({p.name: p.read_bytes() for p in folder.iterdir()})
    assert sent[0] == sent[1] and len(sent[0]) > 5
    assert sorted(r["auction"] for b in sent[0].values() for r in json.loads(b)) == list(range(60))


def test_names_in_views(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE a (k BIGINT, st VARCHAR); CREATE SOURCE st (x BIGINT)")
    e.execute("CREATE MATERIALIZED VIEW v AS SELECT max(k) AS st FROM a GROUP BY st")  # the column goes before the alias
    e.execute("CREATE MATERIALIZED VIEW w AS SELECT k, st FROM a")  # st is a column, not the source
    assert e.plans["w"].sources == ["a"] and e.mode("w") == "stateless"
    e.apply({"a": spark.createDataFrame([(1, "x"), (5, "x"), (3, "y")], "k long, st string")})
    assert rows(e.view("v")) == [(3,), (5,)]
    assert "stateless over a" in e.explain("w")


def test_functions_give_null_for_what_is_not_there(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    q = lambda x: e.query(f"SELECT {x} AS x").first().x
    assert q("REGEXP_EXTRACT('ab1', '([a-z]+)(1)', 2)") == "1"
    assert q("REGEXP_EXTRACT('ab1', '([a-z', 1)") is None and q("REGEXP_EXTRACT('ab1', '(a)', 2)") is None and q("REGEXP_EXTRACT('ab1', '(x)', 1)") is None
    at = dt.datetime(2024, 1, 1, 0, 7)
    assert q("hop_start(TIMESTAMP_NTZ'2024-01-01 00:07:00', 300000, 900000)") == at.replace(minute=5)
    assert q("hop_end(TIMESTAMP_NTZ'2024-01-01 00:07:00', 300000, 900000)") == at.replace(minute=20)


def test_sessions_merge(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE c (u BIGINT, at TIMESTAMP); CREATE MATERIALIZED VIEW v AS SELECT u, SESSION(at, 60000) AS s, count(*) AS n FROM c GROUP BY u, SESSION(at, 60000)")
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    add = lambda *r: e.apply({"c": spark.createDataFrame([(1, t(s)) for s in r], "u long, at timestamp_ntz")})
    add(0, 100)
    assert rows(e.view("v")) == [(1, t(0), 1), (1, t(100), 1)]
    add(50)  # joins the two
    assert rows(e.view("v")) == [(1, t(0), 3)]


def test_count_needs_no_rows(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), retain=2)
    e.run_program("CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE MATERIALIZED VIEW v AS SELECT auction FROM bids WHERE price > 1")
    e.apply({"bids": pairs(spark, (1, 1), (1, 2), (1, 2))})
    e.apply({"bids": zset.add(zset.weighted(pairs(spark, (2, 5))), zset.weighted(pairs(spark, (1, 2)), -1))})
    counted = e.query("SELECT count(*) AS n FROM v")
    assert counted.collect()[0].n == 2 == len(rows(e.view("v"))) and "Scan parquet" not in counted._jdf.queryExecution().toString()
    assert e.query("SELECT count(*) FROM bids WHERE __mv_version = 1").first()[0] == 3


def test_replay_from_the_journal(spark, tmp_path):
    e = sums(spark, tmp_path / "a")
    for batch in (pairs(spark, (1, 10), (2, 5)), zset.weighted(pairs(spark, (2, 5)), -1), pairs(spark, (3, 1))):
        e.apply({"bids": batch})
    new = Engine(spark, str(tmp_path / "b"))
    new.run_program("CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE MATERIALIZED VIEW most AS SELECT max(price) AS p, count(*) AS n FROM bids GROUP BY auction % 1")
    assert new.replay(e) == 3 and rows(new.view("most")) == [(10, 2)] and rows(new.view("most", 1)) == [(10, 2)]
    assert new.replay(e) == 3  # again: nothing


def test_sinks_run_with_retries(spark, tmp_path):
    from tidemark.sinks import runner

    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE MATERIALIZED VIEW v AS SELECT auction, price FROM bids")
    e.execute(f"CREATE SINK f FROM v WITH (connector = 'file', path = '{tmp_path}/out') FORMAT PLAIN ENCODE JSON")
    e.execute("CREATE SINK g FROM v WITH (connector = 'http', url = 'http://x')")
    e.apply({"bids": pairs(spark, (1, 2))})
    e.apply({"bids": pairs(spark, (3, 4))})
    calls = []

    def flaky(sink):
        def write(changes, v):
            calls.append((sink.name, v))
            if sink.name == "g" and len([c for c in calls if c[0] == "g"]) < 3:
                raise OSError("not now")

        return runner.writer(sink) if sink.name == "f" else write

    assert runner.run(e, wait=0.01, write=flaky) == {"f": [1, 2], "g": [1, 2]}
    assert calls == [("g", 1), ("g", 1), ("g", 1), ("g", 2)]
    assert spark.read.text(f"{tmp_path}/out").count() == 2 and runner.run(e, write=flaky) == {"f": [], "g": []}
    for bad in ("connector = 'pigeon'", "connector = 'file'", "connector = 'file', path = 'x', colour = 'red'", "connector = 'jdbc', url = 'x', table = 't'"):
        e.execute(f"CREATE SINK bad FROM v WITH ({bad})")
        with pytest.raises(DefinitionError):
            runner.run(e)


def test_jdbc_sink(spark, tmp_path):
    """On the database that comes with Spark."""
    from tidemark.sinks import runner

    url, driver_class = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE TABLE t (id BIGINT PRIMARY KEY, note VARCHAR); CREATE MATERIALIZED VIEW v AS SELECT id, note FROM t; CREATE SOURCE log (n BIGINT); CREATE MATERIALIZED VIEW l AS SELECT n FROM log")
    put = lambda *r: e.apply({"t": spark.createDataFrame(list(r), "id long, note string")})
    options = {"driver": driver_class}
    spark.createDataFrame([], "id long, note string").write.jdbc(url, "notes", "overwrite", options)
    spark.createDataFrame([], "n long").write.jdbc(url, "lines", "overwrite", options)
    e.execute(f"CREATE SINK s FROM v WITH (connector = 'jdbc', url = '{url}', table = 'notes', key = 'id', driver = '{driver_class}')")
    e.execute(f"CREATE SINK a FROM l WITH (connector = 'jdbc', url = '{url}', table = 'lines', mode = 'append_only', driver = '{driver_class}')")
    read = lambda t: sorted(map(tuple, spark.read.jdbc(url, t, properties=options).collect()))
    put((1, "a"), (2, "b"))
    put((1, "c"))
    e.apply({"log": spark.createDataFrame([(7,), (7,)], "n long")})
    runner.run(e, attempts=1)
    assert read("notes") == [(1, "c"), (2, "b")] and read("lines") == [(7,), (7,)]
    e.store.manifest["cursors"]["s"] = 1  # delivered, but the cursor was lost
    runner.run(e, attempts=1)
    assert read("notes") == [(1, "c"), (2, "b")]
    e.apply({"t": zset.weighted(spark.createDataFrame([(2, "b")], "id long, note string"), -1), "log": zset.weighted(spark.createDataFrame([(7,)], "n long"), -1)})
    with pytest.raises(Exception, match="append-only"):
        runner.run(e, attempts=1)
    assert read("notes") == [(1, "c")]


def test_http_ingest_to_views(spark, tmp_path):
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from tidemark import config
    from tidemark.sources.http_ingest import Ingest

    def post(port, body, path="/ingest", **headers):
        return json.loads(urlopen(Request(f"http://127.0.0.1:{port}{path}", body if isinstance(body, bytes) else json.dumps(body).encode(), headers, method="POST")).read())

    with Ingest(str(tmp_path / "landing"), "bids") as server:
        assert post(server.port, {"auction": 1, "price": 2}) == {"accepted": 1}
        for _ in range(2):  # a repeated request
            assert post(server.port, [{"auction": 1, "price": 3}, {"source": "bids", "data": {"auction": 2, "price": 9}}], **{"Idempotency-Key": "k"}) == {"accepted": 2}
        post(server.port, {"n": 5}, "/ingest?source=other")
        for body, path in ((b"{", "/ingest"), (b"[1]", "/ingest"), (b"{}", "/else")):
            with pytest.raises(HTTPError):
                post(server.port, body, path)
        assert json.loads(urlopen(f"http://127.0.0.1:{server.port}/health").read()) == {"status": "ok"}
    text = f'root = "{tmp_path}/views"\ncheckpoint = "{tmp_path}/check"\nprogram = "CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE SOURCE other (n BIGINT); CREATE MATERIALIZED VIEW v AS SELECT auction, count(*) AS n, max(price) AS p FROM bids GROUP BY auction"\n[[streams]]\nname = "in"\npath = "{tmp_path}/landing"\ndefault_source = "bids"\n'
    c = config.parse(text, "toml")
    assert [x[:2] for x in config.dry_run(spark, c)] == [("v", "sums > stateless")]
    e, queries = config.start(spark, c, available_now=True)
    for q in queries:
        q.awaitTermination()
    assert rows(e.view("v")) == [(1, 2, 3), (2, 1, 9)] and rows(zset.expand(e.store.snapshot("source.other"))) == [(5,)]
    for wrong in ('root = "x"\nprogramme = ""', "retain = 3", 'root = 1\nprogram = ""', 'root = "x"\nprogram = ""\n[[streams]]\nname = "a"', 'root = "x"\n[[streams]]\nname = "a"\npath = "p"\nspeed = 1'):
        with pytest.raises(DefinitionError):
            config.parse(wrong, "toml")
    with pytest.raises(DefinitionError):
        config.dry_run(spark, config.parse('{"root": "x", "program": "CREATE SOURCE a (b PIGEON)"}', "json"))


def test_tables_fed_by_change_data(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE feed (op VARCHAR); CREATE TABLE t (id BIGINT PRIMARY KEY, note VARCHAR NOT NULL) FROM feed TABLE 'public.t'; CREATE MATERIALIZED VIEW v AS SELECT id, note FROM t")
    change = lambda op, lsn, after=None, before=None, table="t": ("feed", json.dumps({"payload": {"op": op, "after": after, "before": before, "source": {"schema": "public", "table": table, "lsn": lsn}}}))
    tick = driver.Ticker(e, "s")
    batch = lambda *r: spark.createDataFrame(list(r), "source string, payload string")
    tick(batch(change("u", 3, {"id": 1, "note": "b"}), change("c", 2, {"id": 1, "note": "a"}), change("r", 1, {"id": 2, "note": "x"}), change("c", 4, {"id": 9, "note": "z"}, table="other")), 0)
    assert rows(e.view("v")) == [(1, "b"), (2, "x")]
    tick(batch(change("d", 5, None, {"id": 2}), change("u", 6, {"id": 1, "note": "c"})), 1)
    assert rows(e.view("v")) == [(1, "c")]


def test_asof_joins_are_windows(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE a (k BIGINT, t BIGINT); CREATE SOURCE b (k BIGINT, t BIGINT, x VARCHAR)")
    e.apply({"a": spark.createDataFrame([(1, 5), (1, 1), (2, 7)], "k long, t long"), "b": spark.createDataFrame([(1, 2, "p"), (1, 5, "q"), (2, 8, "r")], "k long, t long, x string")})
    for sql, want in (
        ("SELECT a.k, a.t, b.x FROM a ASOF JOIN b MATCH_CONDITION (a.t >= b.t) ON a.k = b.k", [(1, 1, None), (1, 5, "q"), (2, 7, None)]),
        ("SELECT l.k, l.t, r.x FROM a l INNER ASOF JOIN b r MATCH_CONDITION (r.t < l.t) ON r.k = l.k WHERE r.x <> 'z'", [(1, 5, "p")]),
        ("SELECT a.t, b.x FROM a LEFT ASOF JOIN b MATCH_CONDITION (a.t <= b.t) ON a.k = b.k", [(1, "p"), (5, "q"), (7, "r")]),
    ):
        found = e.query(sql)
        assert rows(found) == want and "Window" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(e.query("SELECT x FROM a ASOF JOIN b MATCH_CONDITION (a.t >= b.t) ON a.k = b.k AND a.k + 1 > b.k")) == [("q",), (None,), (None,)]


def test_snapshot_then_changes(spark, tmp_path):
    from tidemark.sinks import runner
    from tidemark.sources import snapshot

    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(i, f"n{i}", i) for i in range(50)], "id long, note string, more long").write.jdbc(url, "t", "overwrite", options)
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE feed (op VARCHAR); CREATE TABLE t (id BIGINT PRIMARY KEY, note VARCHAR) FROM feed TABLE 'public.t'")
    e.execute(f"CREATE REPLICATION PIPELINE copy FROM t WITH (connector = 'table', path = '{tmp_path}/copy', key = 'id')")
    found = snapshot.read_table(spark, url, "t", e.sources["t"], 4, options)
    assert found.rdd.getNumPartitions() == 4 and found.columns == ["id", "note"]
    assert snapshot.load(e, "t", found, 100) == 1 and snapshot.load(e, "t", found, 100) == 1
    change = lambda op, lsn, after: ("feed", json.dumps({"op": op, "after": after, "before": None, "source": {"schema": "public", "table": "t", "lsn": lsn}}))
    driver.Ticker(e, "s")(spark.createDataFrame([change("u", 90, {"id": 1, "note": "old"}), change("u", 101, {"id": 2, "note": "new"}), change("c", 102, {"id": 77, "note": "x"})], "source string, payload string"), 0)
    runner.run(e)
    copy = {r.id: r.note for r in spark.read.parquet(f"{tmp_path}/copy/version=2").collect()}
    assert copy == {i: f"n{i}" for i in range(50)} | {2: "new", 77: "x"}


def test_pruned_ingest_and_catalog_tables(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE a (x BIGINT, y BIGINT, z VARCHAR, w VARCHAR); CREATE MATERIALIZED VIEW v AS SELECT x, count(*) AS n FROM a WHERE z = 'q' GROUP BY x")
    assert e.needed("a") == {"x", "z"}
    rows_in = [("a", json.dumps({"x": i % 2, "y": i, "z": "q", "w": "long"})) for i in range(5)]
    driver.Ticker(e, "s", prune=True)(spark.createDataFrame(rows_in, "source string, payload string"), 0)
    assert rows(e.view("v")) == [(0, 3), (1, 2)] and {(r.y, r.w) for r in zset.expand(e.store.snapshot("source.a")).collect()} == {(None, None)}
    spark.createDataFrame([(0, "even"), (1, "odd")], "x long, name string").write.mode("overwrite").saveAsTable("kinds")
    try:
        assert rows(e.query("SELECT name, n FROM v JOIN kinds USING (x)")) == [("even", 3), ("odd", 2)]
    finally:
        spark.sql("DROP TABLE kinds")


def test_server_sent_events(spark, tmp_path):
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from tidemark.sinks.sse import Server

    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE bids (auction BIGINT, price BIGINT); CREATE MATERIALIZED VIEW v AS SELECT auction, price FROM bids")
    e.apply({"bids": pairs(spark, (1, 2))})
    e.apply({"bids": pairs(spark, (3, 4))})

    def read(stream, n):
        out = []
        while len(out) < n:
            line = stream.readline().decode().strip()
            if line.startswith("data: "):
                out.append(json.loads(line[6:]))
        return [(x["__mv_version"], x["auction"], x["__op"]) for x in out]

    with Server(e, wait=0.1) as server:
        at = f"http://127.0.0.1:{server.port}/mv?view=v"
        with urlopen(at) as stream:
            assert read(stream, 2) == [(1, 1, 1), (2, 3, 1)]
            e.apply({"bids": zset.weighted(pairs(spark, (1, 2)), -1)})
            assert read(stream, 1) == [(3, 1, -1)]
        with urlopen(Request(at, headers={"Last-Event-ID": "2"})) as stream:
            assert read(stream, 1) == [(3, 1, -1)]
        with pytest.raises(HTTPError):
            urlopen(at.replace("view=v", "view=w"))
