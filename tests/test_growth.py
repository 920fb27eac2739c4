"""What a task holds and how rows are dealt out, on small tables with the limits set low."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import band, zset
from tidemark.queries import QUERIES
from tidemark.streaming.engine import Engine


def test_range_join_is_dealt_out_and_whole(spark, sf, monkeypatch):
    assert QUERIES["join_range"](spark, sf).rdd.getNumPartitions() >= 8  # one task before
    monkeypatch.setattr(band, "PART", 7)
    xs = [0.0, 0.0, 499.9, 500.0, -3.5, None, float("nan"), float("inf"), -float("inf"), *[250.0 + i / 100 for i in range(60)]]
    a, b = (spark.createDataFrame(list(enumerate(xs)), f"{n} long, {v} double") for n, v in (("a", "x"), ("b", "y")))
    want = a.join(b, (F.col("x") < F.col("y")) & (F.col("y") < F.col("x") + 500)).select("a", "b").collect()
    got = band.band_join(a, b, "x", "y", 500.0).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 1_000


def test_hops_are_dealt_by_the_size_of_the_table(spark, sf):
    assert QUERIES["auction_q5"](spark, sf).rdd.getNumPartitions() >= 8  # merged into one before


def test_ties_of_q19_go_by_bidder(spark, sf, tmp_path):
    folder = str(tmp_path / "ties")
    shutil.copytree(sf, folder)
    os.chmod(folder, 0o755)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1).drop("l_suppkey").crossJoin(spark.range(40).select((39 - F.col("id")).alias("l_suppkey")))
    rows.coalesce(1).sortWithinPartitions(F.desc("l_suppkey")).write.mode("overwrite").parquet(f"{folder}/ties.parquet")
    os.chmod(f"{folder}/lineitem.parquet", 0o644)
    os.remove(f"{folder}/lineitem.parquet")
    os.rename(f"{folder}/ties.parquet", f"{folder}/lineitem.parquet")
    assert sorted((r.rn, r.bidder) for r in QUERIES["auction_q19"](spark, folder).collect()) == [(i + 1, i) for i in range(10)]


SQL = {
    "counts": "SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, sum(x) AS s FROM t GROUP BY g",
    "best": "SELECT g, x FROM (SELECT g, x, ROW_NUMBER() OVER (PARTITION BY g ORDER BY x DESC) AS rn FROM t) q WHERE rn <= 2",
    "several": "SELECT g % 7 AS h, count(DISTINCT x) AS d FROM t GROUP BY g % 7",
    "plain": "SELECT g + 1 AS g1, x FROM t",
}


@pytest.mark.parametrize("name", SQL)
def test_large_deltas_are_dealt_out(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(zset, "TASK_ROWS", 200)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    own = [spark.conf.get(n, None) for n in names]
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program(f"CREATE SOURCE t (g BIGINT, x BIGINT); CREATE MATERIALIZED VIEW v AS {SQL[name]}")
    rows = spark.range(6_000).select((F.col("id") % 900).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 5_003 - 2_000).alias("x"))
    spark.conf.unset(names[1])
    for i in range(3):
        z = zset.weighted(rows.where(f"x % 3 = {i} OR x IS NULL AND g % 3 = {i}"))
        gone = zset.weighted(rows.where("x % 6 = 1 OR x IS NULL AND g % 3 = 1"), -1)
        e.apply({"t": zset.add(z, gone) if i == 2 else z.drop("__weight")})
    e.query("SELECT * FROM t").createOrReplaceTempView("t")
    left = spark.table("t").collect()
    spark.createDataFrame(left, "g long, x long").createOrReplaceTempView("t")
    assert sorted(map(repr, e.view("v").collect())) == sorted(map(repr, spark.sql(SQL[name]).collect()))
    assert [spark.conf.get(n, None) for n in names] == own
    assert zset.dealt(spark.table("t"), 6_000).rdd.getNumPartitions() == 31


def test_settings_deal_out_a_batch(spark, tmp_path, monkeypatch):
    """Parts of a batch follow its rows: as many before as there are cores, however large."""
    monkeypatch.setattr(zset, "TASK_ROWS", 100)
    e = Engine(spark, str(tmp_path / "s"))
    seen = {}
    e.run_program("CREATE SOURCE t (g BIGINT, x BIGINT); CREATE MATERIALIZED VIEW v AS SELECT g, count(*) AS n FROM t GROUP BY g")
    plain = e._delta
    monkeypatch.setattr(e, "_delta", lambda v, *a: (seen.update({v: int(spark.conf.get("spark.sql.shuffle.partitions"))}), plain(v, *a))[1])
    e.apply({"t": spark.range(5_000).select((F.col("id") % 50).alias("g"), F.col("id").alias("x"))})
    assert max(seen.values()) >= 50


def test_unset_partitions_are_spark_s_own(spark, tmp_path, monkeypatch):
    """A large batch in a session that doesn't set its partitions: an error before."""
    monkeypatch.setattr(zset, "TASK_ROWS", 100)
    name, e = "spark.sql.shuffle.partitions", Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE t (g BIGINT); CREATE MATERIALIZED VIEW v AS SELECT g FROM t")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default, get=type(spark.conf).get: default[0] if key == name and default else get(self, key, *default))
    own = spark.conf.get(name)
    try:
        with e._dealt({}):
            e._deal(5_000)
            assert int(spark.conf.get(name)) == 51
    finally:
        spark.conf.set(name, own)


def test_near_is_false_only_without_a_match(spark, monkeypatch):
    z = spark.range(4_000).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("a"), F.format_string("%d", F.col("id") % 50).alias("b"), F.col("id").alias("c"))
    some = z.where("c % 40 = 3").select("a", "b")
    got = {r.c: r["__near"] for r in zset.near(z, some, 100).collect()}
    assert len(got) == 4_000 and all(got[c] for c in range(3, 4_000, 40)) and sum(got.values()) < 1_000
    monkeypatch.setattr(zset, "MOST_BITS", 64)  # too full a map: all are near, none is lost
    assert sum(r["__near"] for r in zset.near(z, some, 100).collect()) > 2_000


def _keyed_rows(spark, where: str):
    rows = spark.range(9_000).select((F.col("id") % 2_999).alias("g"), F.when(F.col("id") % 13 > 0, F.col("id") * 37 % 1_009).alias("x"), F.col("id").alias("i"))
    return rows.where(where)


EXTREMES = "SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, sum(x) AS s, max(x) FILTER (WHERE i < 3000) AS f FROM t GROUP BY g"


@pytest.mark.parametrize("gone, stay, again", [("g % 4 = 0", "g % 4 > 0", False), ("i % 5 = 0", "TRUE", True), ("i >= 6000 AND i % 2 = 0 OR g % 7 = 0", "TRUE", True)])
def test_extremes_are_read_again_only_if_one_goes(spark, tmp_path, monkeypatch, gone, stay, again):
    """Whole groups that go, and groups that lose a row: before, all touched groups were read from the source again."""
    monkeypatch.setattr(zset, "TASK_ROWS", 500)
    e, called = Engine(spark, str(tmp_path / "s")), []
    e.run_program(f"CREATE SOURCE t (g BIGINT, x BIGINT, i BIGINT); CREATE MATERIALIZED VIEW v AS {EXTREMES}")
    plain, semi = e._reread, e._semi_keyed
    monkeypatch.setattr(e, "_reread", lambda *a: (called.append((r := plain(*a)) is not None), r)[1])
    read = []
    monkeypatch.setattr(e, "_semi_keyed", lambda *a: (read.append(1), semi(*a))[1])
    e.apply({"t": _keyed_rows(spark, "i % 3 = 0 AND g % 5 < 4")})
    e.apply({"t": _keyed_rows(spark, "i % 3 = 1 AND g % 5 < 4")})
    away = _keyed_rows(spark, f"i % 3 <> 2 AND g % 5 < 4 AND ({gone})")
    e.apply({"t": zset.add(zset.weighted(_keyed_rows(spark, f"(i % 3 = 2 OR g % 5 = 4) AND {stay}")), zset.weighted(away, -1))})
    assert called == [again] and len(read) == again
    left = _keyed_rows(spark, f"IF(i % 3 = 2 OR g % 5 = 4, {stay}, NOT ({gone}))")
    left.createOrReplaceTempView("t")
    want = sorted(map(repr, spark.sql(EXTREMES).collect()))
    assert sorted(map(repr, e.view("v").collect())) == want
    assert sorted(map(repr, zset.expand(e.store.snapshot("view.v")).collect())) == want
    assert sorted(map(repr, e.query("SELECT g, i FROM t").collect())) == sorted(map(repr, left.select("g", "i").collect()))


def test_a_read_shuffles_only_what_removals_meet(spark, tmp_path, monkeypatch):
    """All layers of a view were shuffled before."""
    monkeypatch.setattr(zset, "TASK_ROWS", 500)
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE t (g BIGINT, x BIGINT, i BIGINT); CREATE MATERIALIZED VIEW v AS SELECT g, x FROM t")
    e.apply({"t": _keyed_rows(spark, "i < 8000")})
    e.apply({"t": zset.add(zset.weighted(_keyed_rows(spark, "i >= 8000")), zset.weighted(_keyed_rows(spark, "i % 50 = 0 AND i < 8000"), -1))})
    met = []
    plain = zset.consolidate
    monkeypatch.setattr(zset, "consolidate", lambda z: (met.append(z.count()), plain(z))[1])
    rows = e.view("v")
    assert 320 <= sum(met) < 4_500
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, _keyed_rows(spark, "NOT (i % 50 = 0 AND i < 8000)").select("g", "x").collect()))
    bad = zset.weighted(_keyed_rows(spark, "i % 50 = 0 AND i < 8000"), -1)
    with pytest.raises(zset.NegativeWeight):  # they are gone already
        e.apply({"t": bad})
