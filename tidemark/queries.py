"""The registered queries of the engine, each with SQL for DuckDB on the same tables.

Most are one text in both dialects; ``D`` writes what the two spell differently. Results are whole
numbers, text or doubles, so that values compare exactly.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import functions
from tidemark.operators import zset
from tidemark.operators.asof import asof_join
from tidemark.operators.band import band_join
from tidemark.plans.rewrite import to_spark
from tidemark.streaming.engine import Engine
from tidemark.types import WEIGHT, Column, SourceDef

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class D:
    """One dialect's spelling of what differs."""

    spark: bool

    def ms(self, t: str) -> str:
        return f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {t})" if self.spark else f"(epoch_us({t}) // 1000)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def cents(self, x: str) -> str:
        return f"CAST(round({x} * 100) AS BIGINT)"

    def tumble(self, t: str, size: int) -> str:
        return f"tumble({t}, {size})" if self.spark else f"make_timestamp(CAST(floor(epoch_us({t}) / {size}000.0) AS BIGINT) * {size}000)"

    def hop(self, rel: str, t: str, slide: int, size: int) -> str:
        """A relation with a row and ``hop`` for each window."""
        if self.spark:
            return f"(SELECT *, explode(starts) AS hop FROM (SELECT *, hop_starts({t}, {slide}, {size}) AS starts FROM {rel}))"
        return f"(SELECT *, make_timestamp((epoch_us({t}) // {slide}000 - i) * {slide}000) AS hop FROM {rel}, generate_series(0, {size // slide - 1}) AS g(i))"

    def text(self, t: str) -> str:
        return f"date_format({t}, 'yyyy-MM-dd')" if self.spark else f"strftime({t}, '%Y-%m-%d')"

    def regex(self, s: str, p: str, i: int) -> str:
        return f"regexp_extract_or_null({s}, '{p}', {i})" if self.spark else f"nullif(regexp_extract({s}, '{p}', {i}), '')"

    def part(self, s: str, d: str, i: int) -> str:
        return f"split_index({s}, '{d}', {i})" if self.spark else f"CASE WHEN len(string_split({s}, '{d}')) > {i} THEN string_split({s}, '{d}')[{i + 1}] END"

    def chars(self, s: str, t: str) -> str:
        return f"count_char({s}, '{t}')" if self.spark else f"CAST((length({s}) - length(replace({s}, '{t}', ''))) // length('{t}') AS BIGINT)"

    def num(self, json: str, key: str) -> str:
        return f"CAST(get_json_object({json}, '$.{key}') AS BIGINT)" if self.spark else f"CAST(json_extract_string({json}, '$.{key}') AS BIGINT)"


# the roles of the auction queries: bids are line items, auctions orders, persons customers
def bid(d: D) -> str:
    return f"(SELECT l_orderkey AS auction, l_suppkey AS bidder, {d.cents('l_extendedprice')} AS price, l_returnflag AS channel, l_shipdate AS date_time, l_linenumber AS ln FROM lineitem)"


def auction(d: D) -> str:
    return f"(SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS category, o_orderdate AS date_time, {d.cents('o_totalprice')} AS reserve, o_orderstatus AS status FROM orders)"


def person(d: D) -> str:
    return "(SELECT c_custkey AS id, c_name AS name, c_mktsegment AS state, c_nationkey AS city FROM customer)"


# of all events: a third has no key, a third has the key 7, the rest their user
_NULL_KEYS = "(SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE user_id END AS k FROM events)"
_WIN = "ROW_NUMBER() OVER (PARTITION BY {} ORDER BY {})"

def _q5(d: D) -> str:
    return f"SELECT auction, count(*) AS num, {d.ms('hop')} AS start FROM {d.hop(bid(d) + ' b', 'date_time', 864_000_000, 4_320_000_000)} h GROUP BY auction, hop"


def _q5_by_auction(d: D) -> str:
    """The same with the bids dealt by auction before each becomes five rows: those aren't shuffled again."""
    slide, size = 864_000_000, 4_320_000_000
    base = f"SELECT /*+ REPARTITION(auction) */ auction, t - pmod(t, {slide}L) AS base FROM (SELECT auction, {d.ms('date_time')} AS t FROM {bid(d)} b)"
    return f"SELECT auction, count(*) AS num, hop AS start FROM (SELECT auction, explode(sequence(base, base - {size - slide}L, -{slide}L)) AS hop FROM ({base})) GROUP BY auction, hop"


#: a bid's page
_URL = "concat('https://www.example.com/', lower(channel), '/', CAST(bidder AS VARCHAR(20)), '/item', CAST(ln AS VARCHAR(20)), CASE WHEN auction % 4 = 0 THEN '' ELSE concat('?query=1&channel_id=', CAST(auction % 100 AS VARCHAR(20))) END)"

_BANDS = ("price < 1000000", "price >= 1000000 AND price < 5000000", "price >= 5000000")


def _q15(d: D) -> str:
    return f"SELECT {d.text('date_time')} AS day, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n{i}, count(DISTINCT bidder) FILTER (WHERE {c}) AS b{i}, count(DISTINCT auction) FILTER (WHERE {c}) AS a{i}" for i, c in enumerate(_BANDS)) + f", count(DISTINCT bidder) AS bidders, count(DISTINCT auction) AS auctions FROM {bid(d)} b GROUP BY {d.text('date_time')}"


def _two_steps(d: D, keys: str, by_bidder: str, of_bidder: str, by_auction: str, of_auction: str, out: str) -> str:
    """Distinct counts as counts of groups with flags: two shuffles of partial groups instead of a copy of each row for each count."""
    names = [k.split(" AS ")[-1] for k in keys.split(", ")]
    same = " AND ".join(f"x.{n} <=> y.{n}" for n in names)
    rel = f"(SELECT *, {d.text('date_time')} AS day, {d.ms('date_time')} AS t FROM {bid(d)} b)"
    one = lambda key, flags, sums: f"(SELECT {keys}, {sums} FROM (SELECT {keys}, {key}, {flags} FROM {rel} GROUP BY {keys}, {key}) GROUP BY {keys})"
    return f"SELECT {', '.join('x.' + n for n in names)}, {out} FROM {one('bidder', by_bidder, of_bidder)} x JOIN {one('auction', by_auction, of_auction)} y ON {same}"


def _q15_two_steps(d: D) -> str:
    n = range(len(_BANDS))
    flags = ", ".join(f"count_if({c}) AS c{i}" for i, c in enumerate(_BANDS))
    sums = lambda key, mark: ", ".join([f"count({key}) AS {key}s", *(f"count(CASE WHEN c{i} > 0 THEN {key} END) AS {mark}{i}" for i in n)])
    of_bidder = "sum(total) AS total, " + ", ".join(f"sum(c{i}) AS n{i}" for i in n) + ", " + sums("bidder", "b")
    return _two_steps(d, "day", "count(*) AS total, " + flags, of_bidder, flags, sums("auction", "a"), "total, " + ", ".join(f"n{i}, b{i}, a{i}" for i in n) + ", bidders, auctions")


def _q16(d: D) -> str:
    return f"SELECT channel, {d.text('date_time')} AS day, max({d.ms('date_time')}) AS latest, count(*) AS total, count(*) FILTER (WHERE price < 1000000) AS low, count(DISTINCT bidder) AS bidders, count(DISTINCT bidder) FILTER (WHERE price < 1000000) AS low_bidders, count(DISTINCT auction) AS auctions FROM {bid(d)} b GROUP BY channel, {d.text('date_time')}"


def _q16_two_steps(d: D) -> str:
    return _two_steps(d, "channel, day", "max(t) AS latest, count(*) AS total, count_if(price < 1000000) AS low", "max(latest) AS latest, sum(total) AS total, sum(low) AS low, count(bidder) AS bidders, count(CASE WHEN low > 0 THEN bidder END) AS low_bidders", "1 AS one", "count(auction) AS auctions", "latest, total, low, bidders, low_bidders, auctions")


SQL: dict[str, Callable[[D], str]] = {
    # auction queries
    "auction_q0": lambda d: f"SELECT auction, bidder, price, {d.ms('date_time')} AS t FROM {bid(d)} b",
    "auction_q1": lambda d: f"SELECT auction, bidder, {d.div('price * 89', '100')} AS price, {d.ms('date_time')} AS t FROM {bid(d)} b",
    "auction_q2": lambda d: f"SELECT auction, price FROM {bid(d)} b WHERE auction % 123 = 0",
    "auction_q3": lambda d: f"SELECT p.name, p.city, p.state, a.id FROM {auction(d)} a JOIN {person(d)} p ON a.seller = p.id WHERE a.category = '1-URGENT' AND p.state IN ('BUILDING', 'MACHINERY')",
    "auction_q4": lambda d: f"SELECT category, {d.div('sum(final)', 'count(final)')} AS final FROM (SELECT a.id, a.category, max(b.price) AS final FROM {auction(d)} a JOIN {bid(d)} b ON a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.date_time + INTERVAL '90' DAY GROUP BY a.id, a.category) m GROUP BY category",
    "auction_q5": lambda d: _q5_by_auction(d) if d.spark else _q5(d),
    "auction_q6": lambda d: f"SELECT seller, {d.div('sum(price)', 'count(price)')} AS price FROM (SELECT a.seller, b.price, {_WIN.format('a.id', 'b.price DESC, b.date_time, b.bidder, b.ln')} AS rn FROM {auction(d)} a JOIN {bid(d)} b ON a.id = b.auction AND b.date_time >= a.date_time) q WHERE rn = 1 GROUP BY seller",
    "auction_q7": lambda d: f"SELECT max(price) AS price, {d.ms(d.tumble('date_time', 864_000_000))} AS start FROM {bid(d)} b GROUP BY {d.tumble('date_time', 864_000_000)}",
    "auction_q8": lambda d: f"SELECT p.id, p.name, count(*) AS n, {d.ms(d.tumble('a.date_time', 864_000_000))} AS start FROM {person(d)} p JOIN {auction(d)} a ON p.id = a.seller GROUP BY p.id, p.name, {d.tumble('a.date_time', 864_000_000)}",
    "auction_q9": lambda d: f"SELECT id, seller, auction, bidder, price, {d.ms('bt')} AS t FROM (SELECT a.id, a.seller, b.auction, b.bidder, b.price, b.date_time AS bt, {_WIN.format('a.id', 'b.price DESC, b.date_time, b.bidder, b.ln')} AS rn FROM {auction(d)} a JOIN {bid(d)} b ON a.id = b.auction AND b.date_time >= a.date_time) q WHERE rn = 1",
    "auction_q12": lambda d: f"SELECT bidder, count(*) AS n FROM {bid(d)} b GROUP BY bidder, {d.tumble('date_time', 864_000_000)}",
    "auction_q13": lambda d: f"SELECT b.auction, b.bidder, b.price, a.category FROM {bid(d)} b JOIN {auction(d)} a ON b.auction = a.id AND b.bidder % 5 = a.seller % 5",
    "auction_q14": lambda d: f"SELECT auction, bidder, price * 908 AS price, CASE WHEN hour(date_time) >= 8 AND hour(date_time) <= 18 THEN 'day' WHEN hour(date_time) <= 6 OR hour(date_time) >= 20 THEN 'night' ELSE 'other' END AS kind, {d.chars('channel', 'R')} AS c FROM {bid(d)} b WHERE price > 1000000 AND price < 5000000",
    "auction_q15": lambda d: _q15_two_steps(d) if d.spark else _q15(d),
    "auction_q16": lambda d: _q16_two_steps(d) if d.spark else _q16(d),
    "auction_q17": lambda d: f"SELECT auction, {d.text('date_time')} AS day, count(*) AS total, count(*) FILTER (WHERE price < 1000000) AS low, min(price) AS least, max(price) AS most, {d.div('sum(price)', 'count(price)')} AS mean, CAST(sum(price) AS BIGINT) AS s FROM {bid(d)} b GROUP BY auction, {d.text('date_time')}",
    "auction_q18": lambda d: f"SELECT auction, bidder, price, {d.ms('date_time')} AS t FROM (SELECT *, {_WIN.format('bidder, auction', 'date_time DESC, ln DESC')} AS rn FROM {bid(d)} b) q WHERE rn <= 1",
    "auction_q19": lambda d: f"SELECT auction, bidder, price, rn FROM (SELECT *, {_WIN.format('auction', 'price DESC, ln' + (', bidder' if d.spark else ''))} AS rn FROM {bid(d)} b) q WHERE rn <= 10",
    "auction_q20": lambda d: f"SELECT b.auction, b.bidder, b.price, a.seller, a.reserve FROM {bid(d)} b JOIN {auction(d)} a ON b.auction = a.id WHERE a.category = '5-LOW'",
    "auction_q21": lambda d: f"SELECT page_id, CASE WHEN lower(substr(url, 1, 5)) = 'https' THEN 'secure' ELSE {d.regex('url', '(?:[?&]|^)(utm_source=[a-z]+)', 1)} END AS channel FROM pages WHERE lower(substr(url, 1, 5)) = 'https' OR {d.regex('url', '(?:[?&]|^)(utm_source=[a-z]+)', 1)} IS NOT NULL",
    "auction_q21_bids": lambda d: f"SELECT auction, bidder, price, channel, CASE WHEN lower(channel) = 'a' THEN '0' WHEN lower(channel) = 'n' THEN '1' ELSE {d.regex('url', '(?:&|^|[?])channel_id=([^&]*)', 1)} END AS channel_id FROM (SELECT *, {_URL} AS url FROM {bid(d)} b) u WHERE {d.regex('url', '(?:&|^|[?])channel_id=([^&]*)', 1)} IS NOT NULL OR lower(channel) IN ('a', 'n')",
    "auction_q22_bids": lambda d: f"SELECT auction, bidder, price, channel, {d.part('url', '/', 3)} AS dir1, {d.part('url', '/', 4)} AS dir2, {d.part('url', '/', 5)} AS dir3 FROM (SELECT *, {_URL} AS url FROM {bid(d)} b) u",
    "auction_q22": lambda d: f"SELECT page_id, {d.part('url', '/', 3)} AS dir1, {d.part('url', '/', 4)} AS dir2, {d.part('url', '/', 5)} AS dir3 FROM pages",
    # projection, filter, predicates
    "select_projection": lambda d: f"SELECT l_orderkey, l_quantity * 2 AS q2, concat(l_returnflag, '-', l_linestatus) AS tag, {d.cents('l_discount')} AS disc FROM lineitem",
    "select_predicates": lambda d: "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus IN ('O', 'P') AND NOT o_orderpriority = '5-LOW') OR o_totalprice BETWEEN 1000 AND 2000 OR o_orderpriority IS NULL",
    "select_case": lambda d: "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS b FROM part",
    "select_like": lambda d: "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00%1' OR c_mktsegment LIKE 'B_IL%'",
    "select_cte": lambda d: "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), few AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN few ON c_custkey = o_custkey",
    "select_values": lambda d: "SELECT k, v, k * 10 AS t FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS x(k, v)",
    "select_null_logic": lambda d: "SELECT event_id, nullif(event_type, 'click') AS e, coalesce(nullif(event_type, 'click'), 'none') AS f, (nullif(event_type, 'click') IS NULL) AS g FROM events",
    "subquery_in": lambda d: "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "subquery_not_in": lambda d: "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "subquery_not_in_null": lambda d: "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END FROM orders)",
    "subquery_exists": lambda d: "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "subquery_not_exists": lambda d: "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "subquery_scalar": lambda d: "SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)",
    "subquery_correlated": lambda d: "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders",
    # joins
    "join_inner": lambda d: f"SELECT o_orderkey, c_name, {d.cents('o_totalprice')} AS cents FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_multi_column": lambda d: "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 25) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "join_residual": lambda d: "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY AND l_extendedprice < o_totalprice",
    "join_one_sided": lambda d: "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 0",
    "join_expression_key": lambda d: "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey % 25",
    "join_left": lambda d: "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": lambda d: "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 150000",
    "join_full": lambda d: "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 15) s FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 10) c ON s_suppkey = c_custkey",
    "join_semi": lambda d: f"SELECT c_custkey FROM customer {'LEFT SEMI' if d.spark else 'SEMI'} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_anti": lambda d: f"SELECT c_custkey FROM customer {'LEFT ANTI' if d.spark else 'ANTI'} JOIN orders ON c_custkey = o_custkey",
    "join_right_semi": lambda d: "SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON c_custkey = o_custkey" if d.spark else "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    "join_right_anti": lambda d: "SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey" if d.spark else "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "join_range": lambda d: "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 500",
    "join_self": lambda d: "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": lambda d: "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name",
    "join_on_aggregate": lambda d: "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x ON c_custkey = o_custkey",
    "join_on_distinct": lambda d: "SELECT c_custkey FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) x ON c_custkey = o_custkey",
    "join_on_values": lambda d: "SELECT n_nationkey, v FROM nation JOIN (VALUES (0, 'zero'), (1, 'one')) AS x(k, v) ON n_regionkey = k",
    "join_null_keys": lambda d: f"SELECT a.event_id AS a, b.least AS b, b.n FROM {_NULL_KEYS} a JOIN (SELECT k, min(event_id) AS least, count(*) AS n FROM {_NULL_KEYS} x GROUP BY k) b ON a.k = b.k",
    # aggregates
    "agg_count_by_key": lambda d: "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "agg_hidden_key": lambda d: "SELECT count(*) AS n FROM orders GROUP BY o_custkey",
    "agg_distinct": lambda d: "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "agg_group_only": lambda d: "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "agg_max": lambda d: f"SELECT l_suppkey, max({d.cents('l_extendedprice')}) AS most FROM lineitem GROUP BY l_suppkey",
    "agg_stats": lambda d: f"SELECT l_returnflag, l_linestatus, count(*) AS n, count(nullif(l_linenumber, 1)) AS nn, CAST(sum({d.cents('l_extendedprice')}) AS BIGINT) AS s, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_linenumber), 6) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_count_distinct": lambda d: "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_shipdate) AS days, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey",
    "agg_filter": lambda d: "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(o_custkey) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS s, max(o_custkey) FILTER (WHERE o_totalprice > 1e9) AS none FROM orders GROUP BY o_orderpriority",
    "agg_global": lambda d: "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderkey) AS least FROM orders",
    "agg_global_empty": lambda d: "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0",
    "agg_int_average": lambda d: f"SELECT l_suppkey, {d.div('sum(l_linenumber)', 'count(l_linenumber)')} AS mean FROM lineitem GROUP BY l_suppkey",
    "agg_min_max_types": lambda d: f"SELECT o_orderstatus, min(o_orderpriority) AS p, max({d.ms('o_orderdate')}) AS t, min(CAST(o_orderdate AS DATE)) = CAST(min(o_orderdate) AS DATE) AS same FROM orders GROUP BY o_orderstatus",
    "agg_decimal": lambda d: "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DECIMAL(25, 2)) AS s FROM orders GROUP BY o_orderstatus",
    "agg_having": lambda d: "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_orderkey) % 2 = 0",
    "agg_by_expression": lambda d: "SELECT o_custkey % 10 AS k, length(o_orderpriority) AS l, count(*) AS n FROM orders GROUP BY o_custkey % 10, length(o_orderpriority)",
    "agg_over_join": lambda d: "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "agg_over_aggregate": lambda d: "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x GROUP BY n",
    "agg_over_topn": lambda d: f"SELECT CAST(sum(c) AS BIGINT) AS s FROM (SELECT {d.cents('o_totalprice')} AS c FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) x",
    "agg_over_union": lambda d: "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x GROUP BY k",
    "agg_grouping_sets": lambda d: "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_cube": lambda d: "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_rollup": lambda d: "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_sum_distinct": lambda d: "SELECT l_suppkey, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey",
    "agg_stddev": lambda d: "SELECT o_orderstatus, round(stddev_samp(o_custkey), 4) AS sd, round(var_pop(o_custkey), 2) AS v FROM orders GROUP BY o_orderstatus",
    # windows, sort, limit
    "topn_partitioned": lambda d: f"SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, {_WIN.format('o_custkey', 'o_totalprice DESC, o_orderkey')} AS rn FROM orders) x WHERE rn <= 3",
    "topn_less_than": lambda d: f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, {_WIN.format('o_custkey', 'o_orderdate, o_orderkey')} AS rn FROM orders) x WHERE 3 > rn AND o_orderkey > 100",
    "topn_equal": lambda d: f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, {_WIN.format('o_custkey', 'o_orderdate, o_orderkey')} AS rn FROM orders) x WHERE rn = 2",
    "topn_global_rank": lambda d: "SELECT o_orderkey, rn FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 20",
    "topn_dedup_latest": lambda d: f"SELECT user_id, event_id, event_type FROM (SELECT *, {_WIN.format('user_id', 'ts DESC, event_id DESC')} AS rn FROM events) x WHERE rn = 1",
    "topn_order_limit": lambda d: "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topn_offset": lambda d: "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 15",
    "topn_over_aggregate": lambda d: "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "topn_over_join_aggregate": lambda d: "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 5",
    "topn_over_join": lambda d: "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice, o_orderkey LIMIT 7",
    "topn_over_union": lambda d: "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) x ORDER BY k DESC LIMIT 9",
    "topn_over_distinct": lambda d: "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 9",
    "sort_only": lambda d: "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC",
    "limit_zero": lambda d: "SELECT n_nationkey FROM nation LIMIT 0",
    "window_ranks": lambda d: "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "window_lag_lead": lambda d: "SELECT event_id, lag(event_id) OVER w AS p, lead(event_id, 2) OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_rows_frame": lambda d: "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, round(avg(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS a FROM orders",
    "window_range_frame": lambda d: "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_partkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS n FROM lineitem",
    # set operations
    "set_union_all": lambda d: "SELECT c_nationkey AS k, 'c' AS t FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier UNION ALL SELECT n_nationkey, 'n' FROM nation",
    "set_union": lambda d: "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_values": lambda d: "SELECT n_nationkey AS k FROM nation UNION ALL VALUES (100), (101)",
    "set_distinct_union": lambda d: "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x",
    "set_union_of_aggregates": lambda d: "SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus",
    "set_intersect": lambda d: "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": lambda d: "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_intersect_all": lambda d: "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except_all": lambda d: "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    # time windows
    "time_tumble": lambda d: f"SELECT {d.ms(d.tumble('ts', 3_600_000))} AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY {d.tumble('ts', 3_600_000)}, event_type",
    "time_hop_any_aggregate": lambda d: f"SELECT {d.ms('hop')} AS start, count(*) AS n, max(event_id) AS last, count(DISTINCT user_id) AS users, round(sum(value), 2) AS v FROM {d.hop('events', 'ts', 1_800_000, 7_200_000)} h GROUP BY hop",
    "time_session": lambda d: ("SELECT user_id, timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start) AS start, n FROM (SELECT user_id, session_window(ts, '30 minutes') AS w, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')) s" if d.spark else "SELECT user_id, epoch_us(min(ts)) // 1000 AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, s"),
    # scalar functions
    "fn_regexp_extract": lambda d: f"SELECT page_id, {d.regex('url', '://([^/]+)/', 1)} AS host, {d.regex('url', '#(top)', 1)} AS mark FROM pages",
    "fn_split_index": lambda d: f"SELECT page_id, {d.part('url', '.', 0)} AS a, {d.part('url', '.', 1)} AS b, {d.part('url', '.', 9)} AS c FROM pages",
    "fn_count_char": lambda d: f"SELECT page_id, {d.chars('url', 't')} AS t, {d.chars('url', 'th')} AS th FROM pages",
    "fn_date_parts": lambda d: f"SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, {d.text('ts')} AS day FROM events",
    "fn_strings": lambda d: "SELECT page_id, upper(url) AS u, length(url) AS n, replace(url, 'example', 'x') AS r, substr(url, 9, 5) AS s, split_part(url, '/', 3) AS p, trim(concat('  ', url, ' ')) AS t, reverse(url) AS v FROM pages",
    "fn_math": lambda d: f"SELECT o_orderkey, o_orderkey % 7 AS m, abs(o_custkey - 500) AS a, {d.div('-o_orderkey', '4')} AS q, round(sqrt(o_custkey), 6) AS s, greatest(o_orderkey, o_custkey) AS g, CAST(sign(o_custkey - 500) AS BIGINT) AS z FROM orders",
    "fn_json": lambda d: f"SELECT event_id, {d.num('props', 'k')} AS k FROM events",
}


def load(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def sql_query(make: Callable[[D], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        functions.register(spark)
        sql = make(D(True))
        for n in (*TABLES, "pages"):
            if n in sql:
                spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
        return spark.sql(to_spark(sql) if "RIGHT " in sql else sql)

    return run


def auction_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bids are dealt to a part for each 8 MB of the table: Spark alone merges parts to one a core, whose groups must all be held."""
    functions.register(spark)
    bids = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bids.createOrReplaceTempView("lineitem")
    size = int(str(bids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(spark.sparkContext.defaultParallelism, min(size >> 23, 20_000) + 1)
    return spark.sql(SQL["auction_q5"](D(True)).replace("REPARTITION(auction)", f"REPARTITION({n}, auction)"))


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    sides = [s.select(F.col("s_suppkey").alias(k), F.col("s_acctbal").alias(v)) for k, v in (("a", "x"), ("b", "y"))]
    return band_join(*sides, "x", "y", 500.0).select("a", "b")


# operators that are functions of DataFrames


def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    others = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("other"), "ts").groupBy("user_id", "ts").agg(F.max("other").alias("other"))
    return asof_join(clicks, others, ["user_id"], "ts", "ts").select("event_id", "user_id", F.col("right_other").alias("other"))


def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    others = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("other"), "ts").groupBy("user_id", "ts").agg(F.max("other").alias("other"))
    return asof_join(clicks, others, ["user_id"], "ts", "ts", "<", "inner").select("event_id", "user_id", F.col("right_other").alias("other"))


_OTHERS = "(SELECT user_id, ts, max(event_id) AS other FROM events WHERE event_type <> 'click' GROUP BY user_id, ts) o"
_CLICKS = "(SELECT user_id, event_id, ts FROM events WHERE event_type = 'click') c"


def zset_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, ("orders",))["orders"].select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1).cast("long").alias(WEIGHT))
    return zset.consolidate(t).select("o_custkey", "o_orderstatus", F.col(WEIGHT).alias("w"))


def zset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, ("customer", "supplier"))
    d = zset.diff_rows(t["customer"].select(F.col("c_nationkey").alias("k")), t["supplier"].select(F.col("s_nationkey").alias("k")))
    return d.select("k", F.col(WEIGHT).alias("w"))


def zset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers in two halves: the second half as a delta, with some rows of the first taken away."""
    t = load(spark, sf_dir, ("orders", "customer"))
    o = t["orders"].select(F.col("o_custkey").alias("k"), "o_orderkey")
    c = t["customer"].select(F.col("c_custkey").alias("k"), "c_mktsegment")
    cut = lambda z, key: (zset.weighted(z.where(F.col(key) % 2 == 0)), zset.add(zset.weighted(z.where(F.col(key) % 2 == 1)), zset.weighted(z.where(F.col(key) % 10 == 0), -1)))
    (o1, do), (c1, dc) = cut(o, "o_orderkey"), cut(c, "k")
    before = zset.consolidate(zset.join_delta(o1.limit(0), o1, c1.limit(0), c1, ["k"]))
    out = zset.consolidate(zset.add(before, zset.join_delta(o1, do, c1, dc, ["k"])))
    return zset.expand(out).select("k", "o_orderkey", "c_mktsegment")


def zset_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, ("orders",))["orders"].select("o_orderstatus", "o_custkey", "o_orderkey")
    a = zset.weighted(o.where("o_orderkey % 2 = 0").drop("o_orderkey"))
    d = zset.add(zset.weighted(o.where("o_orderkey % 2 = 1").drop("o_orderkey")), zset.weighted(o.where("o_orderkey % 10 = 0").drop("o_orderkey"), -1))
    start, _ = zset.group_delta(spark.createDataFrame([], "o_orderstatus string, n long, s long, s_n long"), a, ["o_orderstatus"], {"s": "o_custkey"})
    state, _ = zset.group_delta(start, d, ["o_orderstatus"], {"s": "o_custkey"})
    return state.select("o_orderstatus", "n", "s")


# views kept up to date over three batches, the last with removals; the result is the view's rows

_VIEWS: dict[str, tuple[str, str]] = {
    # name: (the modes of its steps that are expected, the view)
    "view_stateless": ("stateless", "SELECT k, ck * 2 AS ck2, st FROM o WHERE st <> 'P'"),
    "view_union_all": ("stateless", "SELECT k AS x, st FROM o WHERE st = 'F' UNION ALL SELECT ck, pr FROM o WHERE st = 'P'"),
    "view_join": ("join", "SELECT o.k, c.seg, o.st FROM o JOIN c ON o.ck = c.id WHERE c.seg <> 'BUILDING'"),
    "view_count_by_key": ("sums > stateless", "SELECT ck, count(*) AS n FROM o GROUP BY ck"),
    "view_distinct": ("sums > stateless", "SELECT DISTINCT st, pr FROM o"),
    "view_sums": ("sums > stateless", "SELECT st, CAST(sum(ck) AS BIGINT) AS s, count(nullif(ck % 3, 0)) AS c, avg(k) AS a, count(*) FILTER (WHERE ck % 2 = 0) AS f FROM o GROUP BY st HAVING count(*) > 1"),
    "view_stats": ("keyed", "SELECT st, count(*) AS n, count(DISTINCT ck) AS d, CAST(sum(ck) AS BIGINT) AS s, min(k) AS lo, max(k) AS hi, count(*) FILTER (WHERE ck % 2 = 0) AS f FROM o GROUP BY st"),
    "view_having": ("sums > stateless", "SELECT ck, max(k) AS m FROM o GROUP BY ck HAVING count(*) > 10"),
    "view_topn": ("ranked > keyed", "SELECT ck, k, rn FROM (SELECT ck, k, ROW_NUMBER() OVER (PARTITION BY ck ORDER BY cents DESC, k) AS rn FROM o) q WHERE rn <= 2"),
    "view_global_topn": ("top > recompute", "SELECT k, cents FROM o ORDER BY cents DESC, k LIMIT 10 OFFSET 2"),
    "view_topn_over_aggregate": ("sums > stateless > top > recompute", "SELECT ck, count(*) AS n FROM o GROUP BY ck ORDER BY n DESC, ck LIMIT 10"),
    "view_left_join": ("touched", "SELECT c.id, o.k FROM c LEFT JOIN o ON c.id = o.ck AND o.st = 'P'"),
    "view_full_join": ("touched", "SELECT c.id, c.seg, o.k, o.st FROM c FULL JOIN o ON c.id = o.ck AND o.st <> 'O'"),
    "view_anti_join": ("touched", "SELECT id, seg FROM c LEFT ANTI JOIN o ON c.id = o.ck AND o.st = 'F'"),
    "view_agg_over_left_join": ("touched > sums > stateless", "SELECT c.seg, count(o.k) AS n, count(*) AS m FROM c LEFT JOIN o ON c.id = o.ck GROUP BY c.seg"),
    "view_agg_over_join": ("join > sums > stateless", "SELECT c.seg, count(*) AS n, max(o.k) AS m FROM o JOIN c ON o.ck = c.id GROUP BY c.seg"),
    "view_agg_over_aggregate": ("sums > stateless > sums > stateless", "SELECT n, count(*) AS customers FROM (SELECT ck, count(*) AS n FROM o GROUP BY ck) x GROUP BY n"),
    "view_agg_over_union": ("stateless > sums > stateless", "SELECT x, count(*) AS n FROM (SELECT ck AS x FROM o UNION ALL SELECT id FROM c) u GROUP BY x"),
    "view_agg_over_topn": ("top > recompute > recompute", "SELECT CAST(sum(cents) AS BIGINT) AS s FROM (SELECT cents FROM o ORDER BY cents DESC, k LIMIT 10) x"),
    "view_join_on_aggregate": ("sums > stateless > join", "SELECT c.id, x.n FROM c JOIN (SELECT ck, count(*) AS n FROM o GROUP BY ck) x ON c.id = x.ck"),
    "view_multiway": ("join > join > sums > stateless", "SELECT c.seg, m.st, count(*) AS n, max(o.k) AS m FROM o JOIN c ON o.ck = c.id JOIN m ON m.st = o.st GROUP BY c.seg, m.st"),
    "view_union_distinct": ("stateless > sums > stateless", "SELECT ck AS x FROM o UNION SELECT id FROM c WHERE seg = 'BUILDING'"),
    "view_except": ("stateless > stateless > stateless > sums > stateless", "SELECT id AS x FROM c EXCEPT SELECT ck FROM o"),
    "view_intersect": ("stateless > stateless > stateless > sums > stateless", "SELECT id AS x FROM c INTERSECT SELECT ck FROM o WHERE st = 'F'"),
}

_O = SourceDef("o", [Column("k", T.LongType()), Column("ck", T.LongType()), Column("st", T.StringType()), Column("pr", T.StringType()), Column("cents", T.LongType())])
_C = SourceDef("c", [Column("id", T.LongType()), Column("seg", T.StringType())])


def _root(spark: SparkSession) -> str:
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/views-{uuid.uuid4().hex}"


def incremental(name: str) -> Callable[[SparkSession, str], DataFrame]:
    mode, sql = _VIEWS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load(spark, sf_dir, ("orders", "customer"))
        o = t["orders"].select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
        c = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"))
        e = Engine(spark, _root(spark))
        e.add_source(_O)
        e.add_source(_C)
        if " m ON" in sql:
            e.execute("CREATE MATERIALIZED VIEW m AS SELECT DISTINCT st FROM o WHERE st <> 'P'")
        e.execute(f"CREATE MATERIALIZED VIEW v AS {sql}")
        if e.mode("v") != mode:
            raise AssertionError(f"{name} is kept by {e.mode('v')}")
        e.apply({"o": o.where("k % 3 = 0"), "c": c.where("id % 2 = 0")})
        e.apply({"o": o.where("k % 3 = 1"), "c": c.where("id % 2 = 1")})
        away = zset.add(zset.weighted(o.where("k % 3 = 2")), zset.weighted(o.where("k % 12 = 0"), -1))
        e.apply({"o": away, "c": zset.weighted(c.where("id % 10 = 0"), -1)})
        return e.view("v")

    return run


# the auction queries as views of the dialect, over bids, auctions and persons that come in three batches, the last with removals

_BID = SourceDef("bid", [Column("auction", T.LongType()), Column("bidder", T.LongType()), Column("price", T.LongType()), Column("channel", T.StringType()), Column("date_time", T.TimestampNTZType()), Column("ln", T.LongType())])
_AUCTION = SourceDef("auction", [Column("id", T.LongType()), Column("seller", T.LongType()), Column("category", T.StringType()), Column("date_time", T.TimestampNTZType()), Column("reserve", T.LongType()), Column("status", T.StringType())])
_PERSON = SourceDef("person", [Column("id", T.LongType()), Column("name", T.StringType()), Column("state", T.StringType()), Column("city", T.LongType())])
_DAY = 86_400_000
_HOP = D(False).hop(bid(D(False)) + " b", "date_time", 10 * _DAY, 50 * _DAY)

#: name: (modes, the view; its SQL is that of the batch query of the same number unless it is given)
_AUCTION_VIEWS: dict[str, tuple[str, str, str | None]] = {
    **{f"view_q{n}": (mode, {15: _q15, 16: _q16}.get(n, SQL[f"auction_q{n}"])(D(True)).replace(bid(D(True)), "bid").replace(auction(D(True)), "auction").replace(person(D(True)), "person"), None) for n, mode in {0: "stateless", 1: "stateless", 2: "stateless", 3: "join", 4: "join > sums > stateless > sums > stateless", 6: "join > ranked > keyed > sums > stateless", 7: "sums > stateless", 8: "join > sums > stateless", 9: "join > ranked > keyed", 12: "sums > stateless", 13: "join", 14: "stateless", 15: "keyed", 16: "keyed", 17: "sums > stateless", 18: "ranked > keyed", 19: "ranked > keyed", 20: "join"}.items()},
    "view_q5": ("stateless > sums > stateless", f"SELECT auction, count(*) AS num, HOP(date_time, {10 * _DAY}, {50 * _DAY}) AS start FROM bid GROUP BY auction, HOP(date_time, {10 * _DAY}, {50 * _DAY})", f"SELECT auction, count(*) AS num, hop AS start FROM {_HOP} h GROUP BY auction, hop"),
    "view_tumble_offset": ("stateless > sums > stateless", f"SELECT TUMBLE(date_time, {10 * _DAY}, {3 * _DAY}) AS start, max(price) AS most FROM bid GROUP BY TUMBLE(date_time, {10 * _DAY}, {3 * _DAY})", f"SELECT make_timestamp(((epoch_us(date_time) - {3 * _DAY}000) // {10 * _DAY}000) * {10 * _DAY}000 + {3 * _DAY}000) AS start, max(price) AS most FROM {bid(D(False))} b GROUP BY ALL"),
    "view_session": ("recompute", f"SELECT seller, SESSION(date_time, {30 * _DAY}) AS start, count(*) AS n FROM auction GROUP BY seller, SESSION(date_time, {30 * _DAY})", f"SELECT seller, min(date_time) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY seller ORDER BY date_time, id) AS s FROM (SELECT *, CASE WHEN date_time > lag(date_time) OVER (PARTITION BY seller ORDER BY date_time, id) + INTERVAL 30 DAY OR lag(date_time) OVER (PARTITION BY seller ORDER BY date_time, id) IS NULL THEN 1 ELSE 0 END AS new FROM {auction(D(False))} a) a) b GROUP BY seller, s"),
}


_EVENT = SourceDef("event", [Column("event_id", T.LongType()), Column("user_id", T.LongType()), Column("ts", T.TimestampNTZType()), Column("kind", T.StringType())])


def view_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An as-of join in the dialect over two views, kept over three batches."""
    e = Engine(spark, _root(spark))
    e.add_source(_EVENT)
    e.run_program("""
      CREATE MATERIALIZED VIEW clicks AS SELECT event_id, user_id, ts FROM event WHERE kind = 'click';
      CREATE MATERIALIZED VIEW others AS SELECT user_id, ts, max(event_id) AS other FROM event WHERE kind <> 'click' GROUP BY user_id, ts;
      CREATE MATERIALIZED VIEW v AS SELECT c.event_id, c.user_id, o.other FROM clicks c ASOF JOIN others o MATCH_CONDITION (c.ts >= o.ts) ON c.user_id = o.user_id;
    """)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"))
    e.apply({"event": rows.where("event_id % 3 = 0")})
    e.apply({"event": rows.where("event_id % 3 = 1")})
    e.apply({"event": zset.add(zset.weighted(rows.where("event_id % 3 = 2")), zset.weighted(rows.where("event_id % 12 = 0"), -1))})
    return e.query("SELECT event_id, user_id, other FROM v")


def auction_view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    mode, sql, _ = _AUCTION_VIEWS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load(spark, sf_dir, ("orders", "customer", "lineitem"))
        for n, df in t.items():
            df.createOrReplaceTempView(n)
        d = D(True)
        b, a, p = (spark.sql(f"SELECT * FROM {x(d)} x") for x in (bid, auction, person))
        e = Engine(spark, _root(spark))
        used = {}
        for source, rows, key in ((_BID, b, "auction"), (_AUCTION, a, "id"), (_PERSON, p, "id")):
            if re.search(rf"\b(?:FROM|JOIN) {source.name}\b", sql):  # as a relation: bids have a column auction
                e.add_source(source)
                used[source.name] = (rows, key)
        e.execute(f"CREATE MATERIALIZED VIEW v AS {sql}")
        if e.mode("v") != mode:
            raise AssertionError(f"{name} is kept by {e.mode('v')}")
        e.apply({n: rows.where(f"{k} % 3 = 0") for n, (rows, k) in used.items()})
        e.apply({n: rows.where(f"{k} % 3 = 1") for n, (rows, k) in used.items()})
        e.apply({n: zset.add(zset.weighted(rows.where(f"{k} % 3 = 2")), zset.weighted(rows.where(f"{k} % 12 = 0"), -1)) for n, (rows, k) in used.items()})
        return e.view("v")

    return run


def _kept(sql: str) -> str:
    """The SQL over what the three batches leave of the tables."""
    for table, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("customer", "c_custkey")):
        sql = sql.replace(f"FROM {table})", f"FROM {table} WHERE {key} % 12 <> 0)")
    return sql


def _final(sql: str) -> str:
    return f"WITH o AS (SELECT o_orderkey AS k, o_custkey AS ck, o_orderstatus AS st, o_orderpriority AS pr, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 12 <> 0), c AS (SELECT c_custkey AS id, c_mktsegment AS seg FROM customer WHERE c_custkey % 10 <> 0), m AS (SELECT DISTINCT st FROM o WHERE st <> 'P') {sql}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement becomes a view, the view is filled by a batch, its rows are queried."""
    e = Engine(spark, _root(spark))
    e.execute("CREATE SOURCE lineitems (flag VARCHAR, status VARCHAR, quantity BIGINT)")
    e.execute("CREATE MATERIALIZED VIEW by_flag AS SELECT flag, status, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM lineitems GROUP BY flag, status")
    e.apply({"lineitems": load(spark, sf_dir, ("lineitem",))["lineitem"].select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("quantity"))})
    return e.query("SELECT flag, status, n, quantity FROM by_flag")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: sql_query(make) for n, make in SQL.items()},
    **{f.__name__: f for f in (auction_q5, join_range, asof_latest, asof_next, zset_consolidate, zset_diff, zset_join, zset_group)},
    **{n: incremental(n) for n in _VIEWS},
    **{n: auction_view(n) for n in _AUCTION_VIEWS},
    "view_asof": view_asof,
    "flagship": flagship,
}

ORACLE_SQL: dict[str, str] = {
    **{n: make(D(False)) for n, make in SQL.items()},
    "asof_latest": f"SELECT c.event_id, c.user_id, o.other FROM {_CLICKS} ASOF LEFT JOIN {_OTHERS} ON c.user_id = o.user_id AND c.ts >= o.ts",
    "view_asof": "SELECT c.event_id, c.user_id, o.other FROM (SELECT * FROM events WHERE event_type = 'click' AND event_id % 12 <> 0) c ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS other FROM events WHERE event_type <> 'click' AND event_id % 12 <> 0 GROUP BY user_id, ts) o ON c.user_id = o.user_id AND c.ts >= o.ts",
    "asof_next": f"SELECT c.event_id, c.user_id, o.other FROM {_CLICKS} ASOF JOIN {_OTHERS} ON c.user_id = o.user_id AND c.ts < o.ts",
    "zset_consolidate": "SELECT o_custkey, o_orderstatus, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS w FROM orders GROUP BY ALL HAVING w <> 0",
    "zset_diff": "SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT c_nationkey AS k, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) x GROUP BY k HAVING sum(w) <> 0",
    "zset_join": "SELECT c_custkey AS k, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0 AND c_custkey % 10 <> 0",
    "zset_group": "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_orderstatus",
    **{n: _final(sql.replace("LEFT ANTI", "ANTI")) for n, (_, sql) in _VIEWS.items()},
    **{n: _kept(sql or SQL[n.replace("view_", "auction_")](D(False))) for n, (_, _, sql) in _AUCTION_VIEWS.items()},
    "flagship": "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
}
