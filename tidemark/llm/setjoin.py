"""Near-duplicate documents by a chosen-path join on word shingles.

A document's set is its shingles of ``SHINGLE`` words (the whole text, if it has fewer words). Sets
are embedded as ``TOKENS`` MinHash values, each a token (number, value), so that similar sets share
many tokens. A run starts with all sets in one bucket; a set goes on into the children of those of
its tokens that a hash of the bucket's path and the token picks, ``1 / (LEAST * TOKENS)`` of all. Sets
that share tokens share picks, whatever else they hold. Two levels are taken at once, inside the task
that reads the text; buckets of over ``BUCKET`` sets are split on, level by level, down to ``DEPTH``.
Runs are repeated until a pair at the threshold is met in some bucket with the target recall.

Small buckets are brute-forced on bit sketches: pairs that may be similar tie their sets together.
What is tied, in connected components, is a block; the sets of each block are then compared exactly,
all with all, so that no link inside a block is missed. Blocks of over ``PART`` sets or ``PART_BYTES``
are compared in pairs of parts, by as many tasks. Only counts and one tie for each set leave a
comparison, never pairs.

Documents with equal sets are one class from the start, and only one document of a class is compared.

Results for each document: class_id, the least id of its class; group_id, the least id of all that
are linked to it, directly or through others; n_links, the number of other classes within the
threshold of its own; n_copies, the number of documents in its class.

Defined results: a text without words (null, empty) is alone in its class and group; a null id counts
as the least long; rows that repeat an id are members of their own texts' classes; a very long text is
a batch, and if need be a part, of its own, with all its shingles; of equal ids the class takes the
text of the least hash; an empty table gives an empty one; only the two named columns are read, so
others can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, by_bytes, cut, discard, release, whole_groups
from tidemark.llm.components import components
from tidemark.llm.decontaminate import text_buffers, words_of

SHINGLE = 5
LEAST = 0.8
TOKENS = 64
DEPTH = 4
RECALL = 0.999
BUCKET = 512
PART = 1_024
PART_BYTES = 4 << 20
ALIKE = 100  # of 128 sketch bits: one in 46,500 pairs at the threshold is below it
BATCH_BYTES = 2 << 20

_RNG = np.random.default_rng(2_018)
_MUL = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)
_BIT_MUL = _RNG.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def runs_needed(recall: float = RECALL, least: float = LEAST, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met at ``depth`` with the target recall.

    The tokens are drawn once for all runs, so a pair shares a binomial number of them; for each number,
    its children in common are Poisson with mean shared / (least * TOKENS) at each level.
    """
    weight, miss = [], []
    for shared in range(TOKENS + 1):
        weight.append(math.comb(TOKENS, shared) * least**shared * (1 - least) ** (TOKENS - shared))
        meet = 1.0
        for _ in range(depth):
            meet = 1 - math.exp(-shared / (least * TOKENS) * meet)
        miss.append(1 - meet)
    runs = 1
    while sum(w * m**runs for w, m in zip(weight, miss, strict=True)) > 1 - recall:
        runs += 1
    return runs


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(SHINGLE, len(words))):
        h = _mixed(h + words[j : j + n] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def _picks(path: np.ndarray, tokens: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the tokens picked in each row's bucket."""
    h = _mixed(path[:, None] ^ tokens)
    row, col = np.nonzero(h < np.uint64(int(2**64 / (least * TOKENS))))
    return row, _mixed(h[row, col] + np.uint64(0x632BE59BD9B4E019))


def _tokens(mins: np.ndarray) -> np.ndarray:
    return _mixed(mins.astype(np.uint64) * np.uint64(TOKENS) + np.arange(TOKENS, dtype=np.uint64))


def leaves(mins: np.ndarray, runs: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) after two levels of all runs."""
    tokens = _tokens(mins)
    rows, paths = [], []
    for r in range(runs):
        root = np.full(len(mins), _mixed(np.array([r + 1], dtype=np.uint64))[0])
        row, path = _picks(root, tokens, least)
        down, path = _picks(path, tokens[row], least)
        rows.append(row[down])
        paths.append(path)
    return np.concatenate(rows), np.concatenate(paths)


def _sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    words, begin = words_of(*text_buffers(batch.column(column)))
    return [shingles(words[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _name(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    total = np.array([_mixed(s).sum(dtype=np.uint64), _mixed(s * _M2 + np.uint64(1)).sum(dtype=np.uint64)])
    return total.tobytes()


def _embed(runs: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH_BYTES):
            sets = _sets(b, 1)
            some = [i for i, s in enumerate(sets) if len(s)]
            mins = np.zeros((len(some), TOKENS), dtype=np.uint32)
            bits = np.zeros((len(some), 128), dtype=bool)
            for j, i in enumerate(some):
                s = sets[i]
                low = np.full(TOKENS, np.iinfo(np.uint64).max)
                for at in range(0, len(s), 4_096):
                    low = np.minimum(low, (s[at : at + 4_096, None] * _MUL + _ADD).min(0))
                mins[j] = low >> np.uint64(32)
                bits[j, :TOKENS] = (_mixed(low) & np.uint64(1)).astype(bool)
                other = np.full(128 - TOKENS, np.iinfo(np.uint64).max)
                for at in range(0, len(s), 4_096):
                    other = np.minimum(other, (_mixed(s[at : at + 4_096])[:, None] * _BIT_MUL[TOKENS:]).min(0))
                bits[j, TOKENS:] = (_mixed(other) & np.uint64(1)).astype(bool)
            packed = np.packbits(bits, axis=1)
            row, path = leaves(mins, runs, least) if some else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
            order = np.argsort(row, kind="stable")
            path, sizes = path[order].view(np.int64), np.bincount(row, minlength=len(some))
            ends = np.cumsum(sizes)
            slot = {i: j for j, i in enumerate(some)}
            name = [_name(sets[i]) if i in slot else None for i in range(b.num_rows)]
            paths = [path[ends[slot[i]] - sizes[slot[i]] : ends[slot[i]]] if i in slot else [] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(name, pa.binary()), pa.array([packed[slot[i]].tobytes() if i in slot else None for i in range(b.num_rows)], pa.binary()), pa.array([mins[slot[i]].tobytes() if i in slot else None for i in range(b.num_rows)], pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                names=["id", "digest", "set", "sketch", "mins", "paths"],
            )
        release()

    return run


def _children(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            mins = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
            path = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, child = _picks(path, _tokens(mins), least)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1).take(take), b.column(2).take(take)], names=["path", "set", "sketch"])
        release()

    return run


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each sketch of ``a`` and each of ``b`` (eight 16-bit words) may be of similar sets."""
    apart = np.zeros((len(a), len(b)), dtype=np.uint8)
    for j in range(8):
        apart += _POP[a[:, j, None] ^ b[None, :, j]]
    return apart <= 128 - ALIKE


def _tie(keys: np.ndarray, n: int) -> list[int]:
    """The least member of each member's component, from the pairs ``keys`` [m, 2]."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in keys.tolist():
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def _linked(match: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a symmetric matrix of matches, in a few sweeps."""
    n = len(match)
    label = np.arange(n)
    if n == 2:
        return np.array([0, 0 if match[0, 1] else 1])
    while True:
        new = np.where(match, label[None, :], n).min(1, initial=n)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (or pairs of a large bucket's parts), sorted: one tie for each set that may have a partner."""
    for t in whole_groups(batches, 3):
        key = [t.column(i).to_numpy() for i in range(3)]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, 8)
        first = np.flatnonzero(new)
        left, right = [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
            if b - a < 2:
                continue
            label = _linked(_near(sketch[a:b], sketch[a:b]))
            tied = np.flatnonzero(label != np.arange(b - a))
            left.append(tied + a)
            right.append(label[tied] + a)
        sets = t.column("set").combine_chunks()
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        l, r = (pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (left, right))
        yield pa.RecordBatch.from_arrays([sets.take(l), sets.take(r)], names=["u", "v"])
    release()


def _parts(df: DataFrame, n: Column, member: str) -> DataFrame:
    """Each row of a group of ``n`` parts once for every pair of parts that its part is in: lo, hi, own part."""
    n = F.greatest(n, F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(11)), n).cast("int")
    return df.withColumn("_n", n).withColumn("own", own).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("lo", F.least("own", "_p")).withColumn("hi", F.greatest("own", "_p")).drop("_n", "_p")


def _compare(least: float):
    """Blocks (or pairs of a large block's parts) with whole sets: links of each set, and a tie to its component's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3):
            key = [t.column(i).to_pylist() for i in range(3)]
            keys = list(zip(*key, strict=True))
            names, own = t.column("set").to_pylist(), t.column("own").to_pylist()
            out: list[tuple[bytes, bytes, int]] = []
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                some = [i for i in range(at, end) if i == at or names[i] != names[i - 1]]  # rows that repeat an id and text
                sets = [np.frombuffer(t.column("items")[i].as_py(), dtype=np.uint64) for i in some]
                match = _similar(sets, least)
                if keys[at][1] != keys[at][2]:  # two parts: pairs inside one are another task's
                    side = np.array([own[i] for i in some])
                    match &= side[:, None] != side[None, :]
                label, links = _linked(match), match.sum(1)
                out += [(names[i], names[some[int(label[j])]], int(links[j])) for j, i in enumerate(some)]
                at = end
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["u", "v", "links"])
        release()

    return run


def _similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``least`` or more, exactly; by blocks of shared items."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        shared = np.full((2, 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)), dtype=np.float32)
    else:
        items, where = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        often = np.bincount(where) > 1
        number = np.cumsum(often) - 1
        kept = often[where]
        row, col = row[kept], number[where[kept]]
        shared = np.zeros((n, n), dtype=np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        width = max(256, (1 << 22) // n)
        for lo in range(0, int(often.sum()), width):
            a, b = np.searchsorted(col, (lo, lo + width))
            m = np.zeros((n, width), dtype=np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            shared += m @ m.T
    match = np.empty((n, n), dtype=bool)
    for lo in range(0, n, 128):
        union = size[lo : lo + 128, None] + size[None, :] - shared[lo : lo + 128]
        match[lo : lo + 128] = shared[lo : lo + 128] >= np.float64(least) * union - 1e-9
    np.fill_diagonal(match, False)
    return match


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that may be their class's representative, with their sets."""
    for b in by_bytes(batches, 2, BATCH_BYTES):
        sets = _sets(b, 2)
        right = [len(s) > 0 and _name(s) == x for s, x in zip(sets, b.column(0).to_pylist(), strict=True)]
        keep = [i for i, ok in enumerate(right) if ok]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["set", "block", "items"])
    release()


def near_duplicates(docs: DataFrame, key: str, text: str, least: float = LEAST, recall: float = RECALL, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """One row for each document: key, class_id, group_id, n_links, n_copies."""
    runs = runs_needed(recall, least)
    rows = bounded(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    embedded = cut(rows.mapInArrow(_embed(runs, least), "id long, digest long, set binary, sketch binary, mins binary, paths array<long>"))
    first = lambda c: F.first(c).alias(c)
    one = F.min(F.struct("id", "digest")).alias("one")
    classes = cut(embedded.where("set is not null").groupBy("set").agg(one, F.count("*").alias("n_copies"), *map(first, ("sketch", "mins", "paths"))).select("set", F.col("one.id").alias("class_id"), F.col("one.digest").alias("digest"), "n_copies", "sketch", "mins", "paths"))

    level, ties, depth = classes.select(F.explode("paths").alias("path"), "set", "sketch"), [], 2
    while True:
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        last = depth >= DEPTH
        sized = level.join(sizes, "path")
        sized = sized if last else cut(sized)
        small = sized if last else sized.where(F.col("size") <= bucket)
        grouped = _parts(small, F.ceil(F.col("size") / bucket), "set").select("path", "lo", "hi", "set", "sketch")
        ties.append(cut(grouped.repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi").mapInArrow(_bucket_ties, "u binary, v binary").distinct()))
        if last:
            break
        large = sized.where(F.col("size") > bucket)
        if large.isEmpty():
            break
        level = cut(large.select("path", "set", "sketch").join(classes.select("set", "mins"), "set").select("path", "set", "sketch", "mins").mapInArrow(_children(least), "path long, set binary, sketch binary"))
        depth += 1
    edges = ties[0]
    for t in ties[1:]:
        edges = edges.unionByName(t)
    # blocks by 64 bits of the sets' names: should two names agree in them, their blocks are one, which costs comparisons only
    blocks = cut(components(edges.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))))  # node, root
    discard(*ties)
    members = classes.select("set", "class_id", "digest", F.xxhash64("set").alias("node")).join(blocks, "node").select("class_id", "digest", "set", F.col("root").alias("block"))
    # by id and text: null ids, or one that many rows share, meet only rows of their own text
    found = cut(members.join(rows, (members["class_id"] == rows["id"]) & (members["digest"] == rows["digest"])).select("set", "block", "text").mapInArrow(_set_rows, "set binary, block long, items binary"))
    sizes = found.groupBy("block").agg(F.count("*").alias("size"), F.sum(F.length("items")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("size") / part), F.ceil(F.col("bytes") / PART_BYTES))
    # joined by a struct, as in components: the sets of a hot block can be split
    sized = found.withColumn("_w", F.struct("block")).join(sizes.select(F.struct("block").alias("_w"), "size", "bytes"), "_w")
    parted = _parts(sized, parts, "set").select("block", "lo", "hi", "own", "set", "items")
    compared = cut(parted.repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi", "set").mapInArrow(_compare(least), "u binary, v binary, links long"))
    discard(found, blocks)
    links = compared.groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("n_links")).where("n_links > 0")
    groups = components(compared.where("u <> v").select("u", "v").distinct())
    known = classes.select("set", "class_id", "n_copies").join(links, "set", "left").join(groups.withColumnRenamed("node", "set"), "set", "left")
    known = known.select("set", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", F.col("set")).alias("root"))
    heads = known.groupBy("root").agg(F.min("class_id").alias("group_id"))
    known = known.join(heads, "root").select("set", "class_id", "group_id", "n_links", "n_copies")
    out = embedded.select("id", "set").join(known, "set", "left")
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias(key), F.coalesce("class_id", F.col("id")).alias("class_id"), F.coalesce("group_id", F.col("id")).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """``docs`` with only the least id of each group. Rows without an id all stay; an id that repeats with
    one text stays once, and with several texts it stays with all of them if one of them is to stay."""
    judged = near_duplicates(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null"), "key", "text", least)
    kept = judged.where("key = group_id").select(F.struct("key").alias("_keep")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = rows.join(kept, rows["key"] == kept["_keep"]["key"], "left_semi").withColumn("digest", F.xxhash64("text"))
    return chosen.dropDuplicates(["key", "digest"]).select("row.*").unionByName(docs.where(F.col(key).isNull()))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
x AS (SELECT k, doc_id, id, list_sort(list_distinct(list_transform(generate_series(1, greatest(1, len(w) - {SHINGLE - 1})), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')))) AS s, len(w) AS n FROM d),
c AS (SELECT s, min(id) AS class_id, count(*) AS n_copies, row_number() OVER () AS c FROM x WHERE n > 0 GROUP BY s),
g AS (SELECT c, len(s) AS n, unnest(s) AS t FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= {LEAST} * (a.n + b.n - count(*)) - 1e-9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
l AS (SELECT a AS c, count(*) AS n_links FROM e GROUP BY a),
reach(c, r) AS (SELECT a, a FROM l AS q(a, z) UNION SELECT reach.c, e.b FROM reach JOIN e ON reach.r = e.a),
grp AS (SELECT reach.c, min(m.class_id) AS group_id FROM reach JOIN c m ON m.c = reach.r GROUP BY reach.c)
SELECT x.doc_id, coalesce(c.class_id, x.id) AS class_id, coalesce(grp.group_id, c.class_id, x.id) AS group_id,
  coalesce(l.n_links, 0) AS n_links, coalesce(c.n_copies, 1) AS n_copies
FROM x LEFT JOIN c ON x.n > 0 AND x.s = c.s LEFT JOIN l ON l.c = c.c LEFT JOIN grp ON grp.c = c.c"""
