"""Removal of repeated byte strings, by suffix arrays built with linear grouping.

Every byte covered by a ``WINDOW``-byte string that also starts elsewhere in the corpus goes.

1. Each window has an anchor: its ``GRAM`` bytes of least hash, the leftmost of equals. Equal windows
   have equal anchors at equal offsets. Neighbouring windows with one anchor form a segment, one for
   about 84 bytes; a segment travels as two hashes (of its anchor's bytes and of all its bytes) and a place.
2. Segments are pre-aggregated by anchor. An anchor seen once: none of its windows repeats. An anchor
   whose segments are all alike: all windows repeat, there is nothing to sort. Only anchors with
   different segments go on, one copy of each.
3. Those are divided by the anchor's offset in the window, ``GRID`` offsets at a time, into pieces;
   what all windows of a piece share, its core, becomes one symbol between its two flanks. Pieces of
   one core form a bucket. The bucket's suffix array is built by grouping (``suffix_array``), and a
   window repeats if a neighbour in it shares the whole window.
4. A bucket of over ``BUCKET`` pieces isn't sorted in one task. Its pieces are halved: each half has half
   the offsets, and so a core that is longer by as many bytes, which divides the bucket. Halving goes on
   until buckets are small, at the latest to one offset, where the core is the whole window and equal
   cores are equal windows: then there is nothing left to sort.

The join that follows is by document; documents without repeats keep all bytes. Segments are hashed
with 64 bits beside the anchor's 64; equal hashes are taken for equal bytes.

Defined results: null and empty texts have no bytes; the same row twice is twice the text; texts under
``WINDOW`` bytes are never touched; a very long text is a batch of its own, hashed in chunks; an empty
table gives an empty one; only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, by_bytes, cut, release, whole_groups
from tidemark.llm.decontaminate import text_buffers

WINDOW, GRAM, GRID = 200, 32, 32
GRAMS = WINDOW - GRAM + 1
CORE = WINDOW - GRID + 1
BUCKET = 1_500
CHUNK = 1 << 17
BATCH_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(710_2016).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(CHUNK + WINDOW + 1, _BASE), _powers(CHUNK + WINDOW + 1, pow(_BASE, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Hashes of any part of up to ``CHUNK + WINDOW`` bytes."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _UP[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * _DOWN[start])


def anchors(hashed: Hashed, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows 0 .. n - WINDOW: runs with one anchor, as first window of each run and the anchor's place."""
    at = np.arange(n - GRAM + 1, dtype=np.int32)
    low = _mixed((hashed.total[GRAM:] - hashed.total[:-GRAM]) * _DOWN[: n - GRAM + 1])
    size = 1
    while size < GRAMS:
        step = min(size, GRAMS - size)
        less = low[step:] < low[: len(low) - step]
        low = np.where(less, low[step:], low[: len(low) - step])
        at = np.where(less, at[step:], at[: len(at) - step])
        size += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, at[first]


def segments(data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(anchor hash, content hash, first window, windows, anchor place) of a text's segments, in chunks.

    A chunk but the last leaves its last run out, which may go on behind it; the next one begins with that run.
    """
    out = []
    base, n = 0, len(data) - WINDOW + 1
    while base < n:
        part = data[base : base + CHUNK + WINDOW - 1]
        h = Hashed(part)
        first, at = anchors(h, len(part))
        windows = np.diff(np.append(first, len(part) - WINDOW + 1))
        step = len(part) - WINDOW + 1
        if base + step < n:
            step = int(first[-1])
            first, at, windows = first[:-1], at[:-1], windows[:-1]
        out.append((h.of(at, at + GRAM), h.of(first, first + windows + WINDOW - 1), first + base, windows, at + base))
        base += step
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k1, k2 tell rows apart as far as their content does; neither is ever null."""
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("key"), F.coalesce(F.xxhash64(F.lit(1), F.col(key).cast("string")), digest).alias("k1") if dict(docs.dtypes)[key] not in ("bigint", "int") else F.coalesce(F.col(key).cast("long"), digest).alias("k1"), F.hash(F.coalesce(F.col(text), F.lit("")), F.lit(3)).alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches, 2, BATCH_BYTES):
        data, off = text_buffers(b.column(2))
        k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        parts, rows = [], []
        for i in range(b.num_rows):
            if off[i + 1] - off[i] >= WINDOW:
                for s in segments(data[off[i] : off[i + 1]]):
                    parts.append(s)
                    rows.append((i, len(s[0])))
        if not parts:
            continue
        anchor, content, first, windows, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = np.repeat([i for i, _ in rows], [n for _, n in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(k1[row], pa.int64()), pa.array(k2[row], pa.int32()), pa.array(first, pa.int32()), pa.array(windows, pa.int16()), pa.array(at, pa.int32())],
            names=["anchor", "content", "k1", "k2", "first", "windows", "at"],
        )


_SEGMENT = "anchor long, content long, k1 long, k2 int, first int, windows short, at int"


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of integers that end in a unique least one, by linear grouping.

    Suffixes are first grouped by their first symbol, then groups are taken in descending order: the
    previous suffix of a smaller group is found by following pointers; those that are pointed at by l
    suffixes of the group move behind the rest of their own group, more pointers further back. In the
    end a group holds the suffixes of one Lyndon prefix. Then the array is filled from the left: each
    suffix that is placed puts those that end where it begins at the front of their groups.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, head, tail = [0] * n, [0] * n, [0] * n  # place of a suffix; first place of its group; last place, by first place
    start = 0
    for i, x in enumerate(order):
        if i and s[x] != s[order[i - 1]]:
            start = i
        place[x], head[x], tail[start] = i, start, i
    before = [-1] * n
    last = n - 1
    while last >= 0:
        first = head[order[last]]
        members = order[first : last + 1]
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for x in members:
            p = x - 1
            while p >= 0 and head[p] >= first:
                p = before[p]
            before[x] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            if len(count) == 1 or max(count.values()) == 1:
                levels = [list(count)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in count.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in sorted(by, reverse=True)]
            for level in levels:
                ends: dict[int, int] = {}
                for p in level:
                    g = head[p]
                    e = tail[g]
                    if g not in ends:
                        ends[g] = e
                    at, other = place[p], order[e]
                    order[e], order[at] = p, other
                    place[p], place[other] = e, at
                    tail[g] = e - 1
                fresh = {g: tail[g] + 1 for g in ends}
                for p in level:
                    head[p] = fresh[head[p]]
                for g, e in ends.items():
                    tail[fresh[g]] = e
        last = first - 1
    out, done, front = [-1] * n, [False] * n, list(range(n))
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = head[p]
            out[front[g]] = p
            front[g] += 1
            done[p] = True
            p = before[p]
    return out


def neighbours(s: list[int], sa: list[int]) -> list[int]:
    """For each suffix, the longest prefix it shares with a neighbour in the array."""
    n = len(s)
    rank, shared = [0] * n, [0] * (n + 1)
    for i, x in enumerate(sa):
        rank[x] = i
    h = 0
    for x in range(n):
        r = rank[x]
        if r:
            y = sa[r - 1]
            while s[x + h] == s[y + h]:
                h += 1
            shared[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return [max(shared[r], shared[r + 1]) for r in rank]


def repeated_windows(pieces: list[tuple[bytes, bytes]], grid: int = GRID) -> list[list[bool]]:
    """For pieces of one core (left flank, right flank): which of the ``grid`` windows repeat in another piece.

    Window w of a piece has the last ``grid - 1 - w`` bytes of the left flank and the first w of the right.
    """
    k = len(pieces)
    core = k + 257
    s: list[int] = []
    starts = []
    for i, (left, right) in enumerate(pieces):
        starts.append(len(s) + len(left))
        s.extend([b + k + 1 for b in left])
        s.append(core)
        s.extend([b + k + 1 for b in right])
        s.append(i + 1)
    s.append(0)
    shared = neighbours(s, suffix_array(s))
    out = []
    for (left, right), at in zip(pieces, starts, strict=True):
        own = []
        for w in range(grid):
            l = grid - 1 - w
            own.append(l <= len(left) and w <= len(right) and shared[at - l] >= l + 1 + w)
        out.append(own)
    return out


def halves(core: int, c0: int, left: bytes, right: bytes, lo: int, hi: int, grid: int) -> Iterator[tuple[int, int, bytes, bytes, int, int]]:
    """A piece of ``grid`` offsets as up to two of half as many: core's key, its place, flanks, first and last window."""
    half = grid // 2
    middle = c0 - half + 1  # the first window of the second half
    for side, first, last in ((0, lo, min(hi, middle - 1)), (1, max(lo, middle), hi)):
        if first > last:
            continue
        more = right[:half] if side else left[len(left) - half :]
        digest = hashlib.blake2b(core.to_bytes(8, "little", signed=True) + more, digest_size=8, key=bytes([grid, side])).digest()
        key = int.from_bytes(digest, "little", signed=True)
        if side:
            yield key, c0, left[max(0, len(left) - half + 1) :], right[half : 2 * half - 1], first, last
        else:
            yield key, c0 - half, left[max(0, len(left) - 2 * half + 1) : len(left) - half], right[: half - 1], first, last


def _half_rows(grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            cols: list[list] = [[] for _ in range(10)]
            for anchor, core, k1, k2, c0, left, right, lo, hi, n in zip(*(c[x] for x in ("anchor", "core", "k1", "k2", "c0", "lhs", "rhs", "lo", "hi", "n")), strict=True):
                for key, place, l, r, first, last in halves(core, c0, left, right, lo, hi, grid):
                    for col, v in zip(cols, (anchor, key, k1, k2, place, l, r, first, last, n), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["anchor", "core", "k1", "k2", "c0", "lhs", "rhs", "lo", "hi", "n"])
        release()

    return run


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their segments to compare; out: the pieces' buckets, flanks, places and window ranges."""
    for b in by_bytes(batches, 2, BATCH_BYTES):
        cols: list[list] = [[] for _ in range(9)]
        data, off = text_buffers(b.column(2))
        k1, k2, marks = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
        for i in range(b.num_rows):
            text = data[off[i] : off[i + 1]]
            raw = text.tobytes()
            n = len(raw)
            for m in marks[i]:
                x, p0, p1 = m["at"], m["first"], m["first"] + m["windows"] - 1
                for g in range((x - p1) // GRID, (x - p0) // GRID + 1):  # offsets x - p of the grid g
                    lo, hi = max(p0, x - g * GRID - GRID + 1), min(p1, x - g * GRID)
                    c0 = x - g * GRID  # the core: bytes of all windows at offsets of this grid
                    c1 = min(n, c0 + CORE)
                    digest = hashlib.blake2b(raw[max(0, c0) : c1], digest_size=8, key=bytes([g]))
                    row = (m["anchor"], int.from_bytes(digest.digest(), "little", signed=True), k1[i], k2[i], c0, raw[max(0, c0 - GRID + 1) : c0], raw[c1 : c1 + GRID - 1], (lo, hi), m["n"])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.binary()), pa.array([v[0] for v in cols[7]], pa.int32()), pa.array([v[1] for v in cols[7]], pa.int32()), pa.array(cols[8], pa.int64())],
            names=["anchor", "core", "k1", "k2", "c0", "lhs", "rhs", "lo", "hi", "n"],
        )


_PIECE = "anchor long, core long, k1 long, k2 int, c0 int, lhs binary, rhs binary, lo int, hi int, n long"
_MARK = "k1 long, k2 int, start int, stop int"


def _runs(flags: list[bool], lo: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of the runs of true windows."""
    at = None
    for i, f in enumerate([*flags, False]):
        if f and at is None:
            at = i
        elif not f and at is not None:
            yield lo + at, lo + i - 1 + WINDOW
            at = None


def _mark_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], names=["k1", "k2", "start", "stop"])


def _sort_buckets(grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, sorted by (anchor, core): marks of the repeated windows."""
        for t in whole_groups(batches, 2):
            cols = t.to_pydict()
            keys = list(zip(cols["anchor"], cols["core"], strict=True))
            rows, at = [], 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                flanks = list(zip(cols["lhs"][at:end], cols["rhs"][at:end], strict=True))
                for i, flags in zip(range(at, end), repeated_windows(flanks, grid), strict=True):
                    if cols["n"][i] == 1:
                        w = cols["c0"][i] - grid + 1  # the window with the most of the left flank
                        lo, hi = cols["lo"][i] - w, cols["hi"][i] - w
                        rows += [(cols["k1"][i], cols["k2"][i], s, e) for s, e in _runs(flags[lo : hi + 1], cols["lo"][i])]
                at = end
            yield _mark_batch(rows)
        release()

    return run


def repeat_marks(x: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """k1, k2, start, stop: byte ranges of ``x`` (k1, k2, text) that repeat."""
    found = cut(x.select("k1", "k2", "text").mapInArrow(_segment_rows, _SEGMENT))
    # sums are written before they are joined, else the join shares their exchange and a hot anchor can't be split;
    # the joins stay merge joins, as only those are split
    by_anchor = cut(found.groupBy("anchor").agg(F.count("*").alias("seen"), (F.min("content") == F.max("content")).alias("alike")).where("seen > 1").select("anchor", "alike"))
    again = cut(found.join(by_anchor, "anchor"))
    end = F.col("first") + F.col("windows") + WINDOW - 1
    alike = again.where("alike").select("k1", "k2", F.col("first").alias("start"), end.cast("int").alias("stop"))
    one = lambda c: F.first(c).alias(c)
    classes = cut(again.where("not alike").groupBy("anchor", "content").agg(F.count("*").alias("n"), *map(one, ("k1", "k2", "first", "windows", "at"))))
    copies = again.where("not alike").join(classes.where("n > 1").select("anchor", "content").hint("merge"), ["anchor", "content"]).select("k1", "k2", F.col("first").alias("start"), end.cast("int").alias("stop"))
    asked = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "first", "windows", "at", "n")).alias("marks"))
    pieces = cut(x.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "marks").mapInArrow(_piece_rows, _PIECE))
    marks, grid = alike.unionByName(copies), GRID
    while True:
        sizes = cut(pieces.groupBy("anchor", "core").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1"))
        shared = pieces.join(sizes.hint("merge"), ["anchor", "core"])
        if grid == 1:  # the core is the window
            return marks.unionByName(shared.where("n = 1").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + WINDOW).cast("int").alias("stop")))
        small = shared.where(F.col("size") <= bucket).drop("size", "least").repartition("anchor", "core").sortWithinPartitions("anchor", "core")
        marks = marks.unionByName(small.mapInArrow(_sort_buckets(grid), _MARK))
        if sizes.where(F.col("size") > bucket).isEmpty():
            return marks
        pieces = cut(shared.where(F.col("size") > bucket).drop("size", "least").mapInArrow(_half_rows(grid), _PIECE))
        grid //= 2


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches, 1, BATCH_BYTES):
        data, off = text_buffers(b.column(1))
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        starts, stops, sizes = b.column(2), b.column(3), b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        s, e = starts.flatten().to_numpy(zero_copy_only=False), stops.flatten().to_numpy(zero_copy_only=False)
        at = 0
        for i in range(b.num_rows):
            text = data[off[i] : off[i + 1]]
            step = np.zeros(len(text) + 1, dtype=np.int32)
            if sizes[i]:
                np.add.at(step, s[at : at + sizes[i]], 1)
                np.add.at(step, e[at : at + sizes[i]], -1)
                at += sizes[i]
            gone = np.cumsum(step[:-1]) > 0
            n_bytes.append(len(text))
            n_removed.append(int(gone.sum()))
            n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()))
            digests.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, key: str, text: str, bucket: int = BUCKET) -> DataFrame:
    """For each row: key, n_bytes, n_removed, n_spans, and the SHA-256 of the bytes that are left."""
    x = bounded(_keyed(docs, key, text))
    # a set: rows that repeat an id and a text have the same marks, which each of them gets
    marks = repeat_marks(x, bucket).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("m"))
    joined = x.join(marks, ["k1", "k2"], "left").select("key", "text", F.col("m.start").alias("starts"), F.col("m.stop").alias("stops"))
    kind = dict(joined.dtypes)["key"]
    return joined.mapInArrow(_cut_rows, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, s, md5_number(b[s : s + {WINDOW - 1}]) AS h FROM (SELECT k, b, unnest(generate_series(1, octet_length(b) - {WINDOW - 1})) AS s FROM d WHERE octet_length(b) >= {WINDOW})),
m AS (SELECT k, s FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
n AS (SELECT k, s, CASE WHEN s - lag(s) OVER (PARTITION BY k ORDER BY s) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT k, s, sum(new) OVER (PARTITION BY k ORDER BY s) AS g FROM n),
p AS (SELECT k, min(s) AS a, max(s) + {WINDOW - 1} AS z FROM g GROUP BY k, g),
q AS (SELECT k, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS y FROM p),
e AS (SELECT k, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, max(z) AS last,
    string_agg(substr(hex(b), 2 * y + 1, 2 * (a - y - 1)), '' ORDER BY a) AS kept FROM q JOIN d USING (k) GROUP BY k)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || substr(hex(b), 2 * last + 1))) END AS kept_sha256
FROM d LEFT JOIN e USING (k)"""
