"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits and the cue
words of identifiers, in any mix of capitals. At each anchor a small deterministic parser, a pattern matched at one place,
expands to both sides, sets the boundaries and validates: an address's domain, an IP's parts, a
card's Luhn sum, an IBAN's remainder. Nothing is searched twice: a parser skips anchors inside what
it has already read.

Offsets are code points, ends exclusive. Kinds, in the order they are listed: email, ip, card,
phone (the base kinds), then iban, account, login (credentials inside a URL) and secret (keys and tokens).

Defined results: a null text counts as empty and has no spans; spans of different kinds may overlap;
repeated rows are treated each; masking joins overlapping spans, named after the first (the longest, of
those that begin together); a very long text is read whole, in one pass; an empty table gives an empty
one; a column of the input that clashes with the result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, by_bytes, fresh, release

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "login", "secret")
BATCH_BYTES = 4 << 20

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?:IBAN)?[:\x20]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,38})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
_ACCOUNT = re.compile(r"(?:account|acct)(?:\x20(?:number|no\.?|id))?[\x20]?[:#=]?[\x20]?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE | re.ASCII)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_LOGIN = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
_ASSIGNED = re.compile(r"(?:token|secret|password|passwd|api_?key|key)\x20?[=:]\x20?[\"']([^\"'\s]{8,})[\"']", re.IGNORECASE | re.ASCII)
_AWS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")

_CUES = {"iban": "iban", "account": "account", "acct": "account", "token": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "api_key": "secret", "apikey": "secret", "key": "secret"}


#: Characters of an IBAN by country. Fixed values of the public registry.
_IBAN_SIZE = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN_OF = {c: n for n, countries in _IBAN_SIZE.items() for c in countries.split()}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue, kind in _CUES.items():
        a.add_word(cue, (kind, len(cue)))
    for word in ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "-----begin "):
        a.add_word(word, ("key", len(word)))
    a.make_automaton()
    return a


_SHARED: list = []
_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """Lower case with every character in its place: only cues are looked for in it, parsers read the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def spans(text: str | None) -> list[Span]:
    """All spans of ``text``, by kind as listed, then by start."""
    if not text:
        return []
    if not _SHARED:
        _SHARED.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = chain_end = quad_end = phone_end = login_end = secret_end = iban_end = account_end = 0
    for last, (what, size) in _SHARED[0].iter(_lower(text)):
        if what == "digit":
            if last >= chain_end:
                m = _CHAIN.match(text, last)
                chain_end = m.end() if m else last + 1
                if m and m.end() - last >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        found["card"].append(m.span())
            if last >= quad_end:
                run = _DOTTED.match(text, last)
                at, quad_end = last, run.end()
                while m := _QUAD.match(text, at, quad_end):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                        found["ip"].append(m.span())
                    at = m.end() + 1
        elif what == "at":
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and last >= mail_end and (m := _DOMAIN.match(text, last + 1)):
                found["email"].append((start, m.end()))
                mail_end = m.end()
        elif what == "plus":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            start = last - 2
            if start >= login_end and (m := _LOGIN.match(text, start)):
                while start > login_end and text[start - 1] in _SCHEME:
                    start -= 1
                found["login"].append((start, m.end()))
                login_end = m.end()
        elif what == "iban":
            start = last - size + 1
            if start >= iban_end and (m := _IBAN.match(text, start)):
                number = m[1]
                if size := _IBAN_OF.get(number[:2].upper()):  # words that follow look like groups of it
                    at = [i for i, c in enumerate(number) if c != " "][:size]
                    number = number[: at[-1] + 1] if len(at) == size and number[at[-1] + 1 : at[-1] + 2] in ("", " ") else ""
                else:
                    while " " in number and not _iban(number):
                        number = number[: number.rindex(" ")]
                if _iban(number):
                    iban_end = m.start(1) + len(number)
                    found["iban"].append((m.start(1), iban_end))
        elif what == "account":
            start = last - size + 1
            if start >= account_end and (m := _ACCOUNT.match(text, start)):
                found["account"].append(m.span(1))
                account_end = m.end()
        else:  # secret or key
            start = last - size + 1
            if start < secret_end:
                continue
            if what == "secret" and (m := _ASSIGNED.match(text, start)):
                found["secret"].append(m.span(1))
                secret_end = m.end()
            elif what == "key" and (m := _AWS.match(text, start) or _GITHUB.match(text, start) or _PEM.match(text, start)):
                found["secret"].append(m.span())
                secret_end = m.end()
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def mask(text: str | None, marked: list[Span]) -> str | None:
    """``text`` with each span (overlapping ones joined) replaced by its kind in angle brackets."""
    if not marked:
        return text
    out, at, end, joined = [], 0, 0, []
    for kind, a, b in sorted(marked, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    for kind, a, end in joined:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(df: DataFrame, text: str, out: str = "pii") -> DataFrame:
    """``df`` with column ``out``: the spans of each whole text."""
    names = [c for c in df.columns if c != out]
    work = fresh(df, "_text")
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, len(names), BATCH_BYTES):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, _ARROW_SPANS)], names=[*names, out])
        release()

    return bounded(df).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(work)).mapInArrow(run, schema)


def mask_pii(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the spans of ``text`` masked; same columns."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at, BATCH_BYTES):
            masked = pa.array([mask(t, spans(t)) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], masked, *b.columns[at + 1 :]], names=b.schema.names)
        release()

    return bounded(df).mapInArrow(run, df.schema)


def digest(marked: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in marked)


def pii_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """For each row: key, the counts of the base kinds, the digest of the base spans, all spans."""
    kind = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    found = find_pii(df.select(key, text), text).drop(text)
    return found.select(key, *map(kind, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def sha(marked: list[Span]) -> str:
    return hashlib.sha256(digest([s for s in marked if s[0] in BASE]).encode()).hexdigest()
