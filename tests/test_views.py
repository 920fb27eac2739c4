"""Views under generated insertions and removals, against the query itself over what the sources hold."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tidemark.operators import zset
from tidemark.plans.rewrite import to_spark
from tidemark.streaming.engine import Engine

O, C = "k long, ck long, st string, n long", "id long, seg string"

VIEWS = {
    "where": "SELECT k + 1 AS k1, st FROM o WHERE n > 2 OR n IS NULL",
    "both": "SELECT k, st FROM o WHERE st = 'a' UNION ALL SELECT id, seg FROM c",
    "inner": "SELECT o.k, c.seg FROM o JOIN c ON o.ck = c.id AND o.n < 8",
    "left": "SELECT c.id, c.seg, o.k FROM c LEFT JOIN o ON c.id = o.ck AND o.st = 'a'",
    "full": "SELECT c.id, o.k FROM c FULL JOIN o ON c.id = o.ck",
    "anti": "SELECT k, st FROM o LEFT ANTI JOIN c ON o.ck = c.id",
    "counts": "SELECT st, count(*) AS n, count(n) AS nn, sum(n) AS s, avg(n) AS a, min(n) AS lo, max(k) AS hi FROM o GROUP BY st",
    "filtered": "SELECT ck % 2 AS p, count(*) FILTER (WHERE n > 3) AS f, max(n) FILTER (WHERE st = 'b') AS m FROM o GROUP BY ck % 2 HAVING count(*) > 1",
    "several": "SELECT st, count(DISTINCT ck) AS d, count(*) AS n FROM o GROUP BY st",
    "distinct": "SELECT DISTINCT ck, st FROM o WHERE n IS NOT NULL",
    "union": "SELECT ck AS x FROM o UNION SELECT id FROM c",
    "except": "SELECT id AS x, seg FROM c EXCEPT SELECT ck, st FROM o",
    "intersect": "SELECT ck AS x FROM o INTERSECT SELECT id FROM c",
    "first": "SELECT ck, k, n FROM (SELECT ck, k, n, ROW_NUMBER() OVER (PARTITION BY ck ORDER BY n DESC, k, st) AS rn FROM o WHERE st <> 'c') q WHERE rn <= 2 AND k > 0",
    "third": "SELECT st, k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY st ORDER BY k, n, ck) AS rn FROM o) q WHERE 3 = rn",
    "top": "SELECT k, n FROM o WHERE st IS NOT NULL ORDER BY n DESC NULLS LAST, k, ck, st LIMIT 4 OFFSET 1",
    "by_segment": "SELECT c.seg, count(*) AS n, max(o.n) AS m, sum(o.k) AS s FROM o JOIN c ON o.ck = c.id GROUP BY c.seg",
    "joined_counts": "SELECT c.seg, x.n FROM c JOIN (SELECT ck, count(*) AS n FROM o GROUP BY ck) x ON c.id = x.ck",
    "mean_of_best": "SELECT seg, avg(n) AS a FROM (SELECT c.seg, o.n, ROW_NUMBER() OVER (PARTITION BY c.id ORDER BY o.n DESC, o.k, o.st, c.seg) AS rn FROM o JOIN c ON o.ck = c.id) q WHERE rn = 1 GROUP BY seg",
    "three": "SELECT x.k, y.seg, z.n FROM o x JOIN c y ON x.ck = y.id JOIN o z ON z.st = y.seg AND z.k > x.k WHERE x.n > 1",
    "by_three": "SELECT y.seg, count(*) AS n, sum(x.k) AS s FROM o x JOIN c y ON x.ck = y.id JOIN d z ON z.id = y.id GROUP BY y.seg",
    "exists": "SELECT id FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.ck = c.id)",
    "all": "SELECT count(*) AS n, sum(n) AS s FROM o",
}


@pytest.mark.parametrize("seed", [1])
def test_views_under_mutations(spark, tmp_path, seed):
    r = random.Random(seed)
    e = Engine(spark, str(tmp_path / "s"))
    e.run_program("CREATE SOURCE o (k BIGINT, ck BIGINT, st VARCHAR, n BIGINT); CREATE SOURCE c (id BIGINT, seg VARCHAR); CREATE MATERIALIZED VIEW d AS SELECT DISTINCT id FROM c")
    for name, sql in VIEWS.items():
        e.execute(f"CREATE MATERIALIZED VIEW v_{name} AS {sql}")
    some = lambda *xs: r.choice([*xs, None])
    make = {"o": lambda: (r.randrange(6), some(1, 2, 3, 4), some("a", "b", "c"), some(*range(10))), "c": lambda: (some(1, 2, 3, 5), some("a", "x", "y"))}
    held: dict[str, list] = {"o": [], "c": []}
    for tick in range(3):
        batch = {}
        for n, schema in (("o", O), ("c", C)):
            if tick and r.random() < 0.25:
                continue
            new = [make[n]() for _ in range(r.randrange(1, 14))]
            gone = r.sample(held[n], r.randrange(len(held[n]) // 2 + 1)) if tick != 1 else []  # the second tick only adds
            left = Counter(held[n]) - Counter(gone)
            held[n] = [*left.elements(), *new]
            batch[n] = zset.add(zset.weighted(spark.createDataFrame(new, schema)), zset.weighted(spark.createDataFrame(gone, schema), -1))
        e.apply(batch)
        for n, schema in (("o", O), ("c", C)):
            spark.createDataFrame(held[n], schema).createOrReplaceTempView(f"all_{n}")
        for name, sql in VIEWS.items():
            for n, schema in (("o", O), ("c", C)):
                spark.createDataFrame(held[n], schema).createOrReplaceTempView(n)
            spark.createDataFrame(held["c"], C).select("id").distinct().createOrReplaceTempView("d")
            want = spark.sql(to_spark(sql)).collect()
            assert Counter(map(tuple, e.view(f"v_{name}").collect())) == Counter(map(tuple, want)), (name, tick, e.mode(f"v_{name}"))
