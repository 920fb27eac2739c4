"""URL rules indexed by their rarest literal token; Spark expressions only.

Every rule has a regular expression and the literal tokens that any URL it matches must hold.
The rarest of those tokens, counted over the URLs, is its key in the index. A URL's tokens
fetch the rules filed under them, and only those rules run their expression.

Up to ``INLINE_RULES`` rules the index is a constant map inside the plan, so the URLs are judged
in one narrow pass without any shuffle; its keys are a hash set there, so that the map is only searched for
tokens that it has. A longer list is joined by token in broadcast blocks of ``BLOCK_RULES`` rules (some
100 bytes each), never by a shuffle of tokens, which a common one would make uneven; found rules are
put together by distinct address. Both ways give the same rows.

``pattern_rule`` reads a line of the usual filter lists: ``||`` before a host, ``|`` at an end, ``*``
for anything, ``^`` for a separator, ``@@`` for an exception.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and the
default verdict. Repeated rows are judged alike, each on its own. An empty table gives an empty one. A
very long URL is judged whole. Columns of the input that clash with the results are replaced. Of several
site rules the longest wins; of several patterns an exception, then the longest, then the last name.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

INLINE_RULES, BLOCK_RULES = 4_000, 100_000
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_INDEX = "map<string,array<struct<size:int,name:string,verdict:string,regex:string,site:boolean>>>"


@dataclass(frozen=True)
class Rule:
    """``site`` rules (host and path) go before patterns; among either, exceptions, then the longest, then the name."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool = False

    @property
    def size(self) -> int:
        return len(self.name) if self.site else len(self.regex) + (1 << 20 if self.verdict == "allow" else 0)


def site_rule(verdict: str, site: str) -> Rule:
    """``host/path``: fits the host and all its subdomains where the URL's path starts with the rule's."""
    host, slash, rest = site.partition("/")
    path = slash + rest
    whole = re.findall(r"[a-z0-9]+", host.lower())
    inner = re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)  # the last token may go on in the URL
    return Rule(site, verdict, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path)}", tuple(whole + [t.lower() for t in inner]), True)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def label_rule(name: str, *words: str) -> Rule:
    """Blocks hosts that have ``words`` side by side, divided by hyphens or dots."""
    return Rule(name, "block", r"^(?:[^/]*[.-])?" + "[.-]".join(map(_quote, words)) + r"(?:[.:-][^/]*)?(?:/|$)", tuple(words))


def pattern_rule(line: str) -> Rule | None:
    """A line of a filter list, for host and path together in any mix of capitals; None for blank lines and comments."""
    line = line.strip()
    if not line or line.startswith("!"):
        return None
    if "$" in line or "##" in line:
        raise ValueError(f"options and element rules have no meaning here: {line!r}")
    allow, body = line.startswith("@@"), line.removeprefix("@@")
    host, start = body.startswith("||"), body.startswith("|")
    body = body.removeprefix("||") if host else body.removeprefix("|")
    end, body = body.endswith("|"), body.removesuffix("|")
    spelled = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    regex = "(?i)" + (r"^(?:[^/]*\.)?" if host else "^" if start else "") + "".join(spelled.get(c) or _quote(c) for c in body) + ("$" if end else "")
    bounded = ("/" if host or start else "a") + body + ("/" if end else "a")  # what may go on in the URL ends no token
    tokens = re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", bounded)
    return Rule(line, "allow" if allow else "block", regex, tuple(t.lower() for t in tokens))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UP, _LOW)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(address), "[^a-z0-9]+"))


def token_counts(addresses: DataFrame, column: str, rules: list[Rule]) -> dict[str, int]:
    """How many addresses hold each of the rules' tokens: at most one row a token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held = addresses.select(F.explode(F.array_intersect(_tokens(F.col(column)), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(df: DataFrame, url: str, rules: list[Rule], default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """``df`` with columns host, path, rule, pattern and verdict; columns of these names are replaced."""
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token to index it by")
    out = df.drop(*({"host", "path", "rule", "pattern", "verdict"} - {url}))
    link, address, found = fresh(out, "_url"), fresh(out, "_address"), fresh(out, "_found")
    out = out.withColumn(link, F.col(f"`{url}`")).withColumn("host", host_of(F.col(link))).withColumn("path", path_of(F.col(link)))
    out = out.withColumn(address, F.concat("host", "path"))
    if not rules:
        none = F.lit(None).cast("string")
        return out.withColumns({"rule": none, "pattern": none, "verdict": F.lit(default)}).drop(link, address)
    seen = token_counts(out, address, rules)
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(r)
    if len(rules) <= inline:
        index = F.from_json(F.lit(json.dumps({t: [{"size": r.size, "name": r.name, "verdict": r.verdict, "regex": r.regex, "site": r.site} for r in rs] for t, rs in filed.items()})), _INDEX)
        known = F.filter(_tokens(F.col(address)), lambda t: t.isin(*filed))
        fetched = F.flatten(F.transform(known, lambda t: F.try_element_at(index, t)))
        out = out.withColumn(found, F.filter(fetched, lambda c: F.rlike(F.col(address), c["regex"])))
        best = lambda site: F.array_max(F.transform(F.filter(F.col(found), lambda c: c["site"] == F.lit(site)), lambda c: F.struct(c["size"].alias("size"), c["name"].alias("name"), c["verdict"].alias("verdict"))))
        site, pattern = best(True), best(False)
        return _verdict(out, site, pattern, default).drop(link, address, found)
    # a long list: distinct addresses, joined by token with the index, then back to the rows
    flat = [(t, r.size, r.name, r.verdict, r.regex, r.site) for t, rs in filed.items() for r in rs]
    tokens = out.select(address).distinct().select(address, F.explode(_tokens(F.col(address))).alias("token"))
    hits = None
    for at in range(0, len(flat), BLOCK_RULES):
        index = df.sparkSession.createDataFrame(flat[at : at + BLOCK_RULES], "token string, size int, name string, verdict string, regex string, site boolean")
        some = tokens.join(F.broadcast(index), "token").where(F.rlike(F.col(address), F.col("regex")))
        hits = some if hits is None else hits.unionByName(some)
    one = F.struct("size", "name", "verdict")
    judged = hits.groupBy(address).agg(F.max(F.when(F.col("site"), one)).alias("_site"), F.max(F.when(~F.col("site"), one)).alias("_pattern"))
    return _verdict(out.join(judged, address, "left"), F.col("_site"), F.col("_pattern"), default).drop(link, address, "_site", "_pattern")


def _verdict(df: DataFrame, site: Column, pattern: Column, default: str) -> DataFrame:
    return df.withColumns({"rule": site["name"], "pattern": pattern["name"], "verdict": F.coalesce(site["verdict"], pattern["verdict"], F.lit(default))})


#: The rules of the query, host and path.
SITE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Words of hosts that the query blocks beside them: each of the first before each of the second, and words on their own.
BEFORE = "bargain best bulk cheap discount easy fast free hot instant live lucky mega online royal secret spam super top vip".split()
AFTER = "backlinks bets betting bingo cams coins cracks credit dating diplomas essays farm followers jackpot keygen likes loans lottery miracle payday pharmacy pills poker replica signals slots torrents viagra warez win".split()
ALONE = [("casino",), ("payday", "loans")]
#: Lines of a filter list.
LINES = """
! trackers, advertisements and machine-made pages
/adserver/
/adclick/
/ads/banner^
/banners/*/click^
/doorway/*/index^
/popunder.
/popup/ad^
/tracking/pixel.
/track/click^
/wp-admin/
/wp-content/plugins/*/spam^
/cgi-bin/counter^
||adserver.
||adtrack.
||clicks.*.biz/
||doubleclick.
||parked-domain.
||popads.
||linkfarm.
|login.
/article-spinner/
/keyword-list/
/print-this-page|
@@/ads/banner-policy^
@@||help.*/popup/ad^
"""


def default_rules() -> list[Rule]:
    labels = [(a, b) for a in BEFORE for b in AFTER] + ALONE
    return [site_rule(*r) for r in SITE_RULES] + [label_rule("-".join(words), *words) for words in labels] + [r for line in LINES.splitlines() if (r := pattern_rule(line))]


def _oracle() -> str:
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    rules = default_rules()
    sites = values([(s, v, s.partition("/")[0], "/" + s.partition("/")[2]) for v, s in SITE_RULES])
    labels = values([(r.name, r.size, r.tokens[0], r.tokens[-1], len(r.tokens)) for r in rules if not r.site and "-".join(r.tokens) == r.name])
    lines = values([(r.name, r.size, r.verdict, r.regex) for r in rules if not r.site and "-".join(r.tokens) != r.name])
    return f"""
WITH sites(rule, v, h, p) AS (VALUES {sites}), labels(pattern, size, a, b, n) AS (VALUES {labels}), lines(pattern, size, v, re) AS (VALUES {lines}),
u AS (SELECT page_id, row_number() OVER () AS k,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_LOW}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
s AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
      FROM u JOIN sites ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
x AS (SELECT k, string_split_regex(host, '[.-]') AS w FROM u),
y AS (SELECT k, unnest(list_zip(list_concat([NULL], w), w)) AS z FROM x),
q AS (SELECT k, z[1] AS a, regexp_replace(z[2], ':.*$', '') AS b FROM y WHERE z[2] IS NOT NULL),
l AS (SELECT k, pattern, size, 'block' AS v FROM q JOIN labels ON q.b = labels.b AND (labels.n = 1 OR q.a = labels.a)
      UNION ALL SELECT k, pattern, size, v FROM u JOIN lines ON regexp_matches(host || path, re)),
m AS (SELECT k, max(struct_pack(size := size, pattern := pattern, v := v)) AS m FROM l GROUP BY k)
SELECT page_id, host, path, s.rule, m.m.pattern AS pattern, coalesce(s.v, m.m.v, 'allow') AS verdict
FROM u LEFT JOIN s USING (k) LEFT JOIN m USING (k)"""


ORACLE = _oracle()
