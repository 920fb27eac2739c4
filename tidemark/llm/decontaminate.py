"""Benchmark decontamination by suffix arrays of the training text.

Each ``SHARD_BYTES`` of documents are a shard. Its words become integers (64-bit hashes of their bytes,
found in one vectorised pass; equal hashes are taken for equal words), and all its suffixes are sorted
by their first ``WINDOW`` words: the shard's suffix array. Every test window is then binary-searched in
it, which gives its range and so all its places. Places of neighbouring windows on one diagonal join
to the longest verbatim match.

Documents are never shuffled. The benchmark is sent to the tasks in blocks of at most ``BLOCK_BYTES``
of text, each a broadcast of about three times that. A larger benchmark takes a pass over the
documents for each block: its matches are added, the rows are written to the shared scratch folder,
and its broadcast is destroyed before the next.

Words are runs of digits, letters (A-Z lower-cased) and all characters from U+0080 on. A window is
``WINDOW`` words of an item, or the whole item if it is shorter.

Defined results: null and empty texts have no words; items without words, text or id match nothing;
repeated items count once by id; repeated documents are judged each; columns of the input that clash
with the results are replaced; a very long text is a shard of its own and is searched whole; without
documents the result is empty, and without a benchmark nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, by_bytes, cut, fresh, release

WINDOW = 8
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
CHUNK = 1 << 18

_BYTE = np.arange(256)
_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
_RANDOM = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(n, _STEP), _powers(n, pow(_STEP, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i + 1]]`` in order, and where each text's words begin."""
    n = len(data)
    is_word = _WORD[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = is_word
    inner = offsets[offsets < n]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before[:n])
    after = np.zeros(n, dtype=bool)
    after[: n - 1] = is_word[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # chunks of whole words, so that long texts take little memory
        lo = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        hi = ends[end - 1]
        up, down = _tables(max(CHUNK, hi - lo) + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_RANDOM[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        hashes[at:end] = (total[e] - total[s]) * down[s]
        at = end
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    return hashes, np.searchsorted(starts, offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class TestSuffixes:
    """A block of the benchmark: its words as ranks in its own vocabulary, and its windows, ready to be searched.

    About 12 bytes for each word of the block; keys are made for each shard.
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, str]]):
        self.names = np.array([str(i) for i, _ in items], dtype=object)
        words, begin = words_of(*text_buffers(pa.array([t for _, t in items], pa.string())))
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.rank = rank.astype(np.int32)
        n = np.diff(begin)
        width = np.minimum(n, WINDOW)
        windows = np.where(n > 0, n - width + 1, 0)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), windows)
        self.start = (np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        self.size = width[self.item].astype(np.int8)
        self.at = begin[self.item].astype(np.int64) + self.start

    def search(self, words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all occurrences: the shard's whole suffix array, then a binary search of every window.

        A window with a word that the shard doesn't hold is known not to be there.
        """
        none = np.zeros(0, dtype=np.int64)
        if not len(words) or not len(self.item):
            return none, none
        vocabulary, rank = np.unique(words, return_inverse=True)
        bits = int(len(vocabulary) + 1).bit_length()
        order, keys = suffix_array(rank.astype(np.int64) + 1, begin, bits)
        near = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        here = np.where(vocabulary[near] == self.vocabulary, near + 1, 0)[self.rank]
        gaps = np.concatenate([[0], np.cumsum(here == 0)])
        some = np.flatnonzero(gaps[self.at + self.size] == gaps[self.at])
        if not len(some):
            return none, none
        padded = np.append(here, np.zeros(WINDOW, dtype=here.dtype))
        low = np.zeros((len(some), WINDOW), dtype=np.int64)
        high = np.full((len(some), WINDOW), (1 << bits) - 1, dtype=np.int64)
        for j in range(WINDOW):
            inside = self.size[some] > j
            low[inside, j] = high[inside, j] = padded[self.at[some[inside]] + j]
        lo = np.searchsorted(keys, _joined([low[:, j] for j in range(WINDOW)], bits), side="left")
        hi = np.searchsorted(keys, _joined([high[:, j] for j in range(WINDOW)], bits), side="right")
        n_found = np.maximum(hi - lo, 0)
        nth = np.arange(n_found.sum()) - np.repeat(np.cumsum(n_found) - n_found, n_found)
        return np.repeat(some, n_found), order[np.repeat(lo, n_found) + nth]


def _numbers(ranks: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Words' ranks side by side in 63-bit numbers, the first words first."""
    each = 63 // bits
    out = []
    for a in range(0, WINDOW, each):
        number = np.zeros(len(ranks[0]), dtype=np.int64)
        for j in range(a, min(a + each, WINDOW)):
            number = (number << bits) | ranks[j]
        out.append(number)
    return out


def _joined(ranks: list[np.ndarray], bits: int) -> np.ndarray:
    """Keys whose order as bytes is that of the ranks, word by word."""
    numbers = _numbers(ranks, bits)
    return np.ascontiguousarray(np.stack(numbers, 1).astype(">i8")).view(f"S{8 * len(numbers)}").ravel()


def suffix_array(rank: np.ndarray, begin: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the texts in the order of their first ``WINDOW`` words (a text's end before any word), and their keys."""
    n = len(rank)
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(n)  # words up to the text's end
    padded = np.append(rank, np.zeros(WINDOW, dtype=rank.dtype))
    numbers = _numbers([np.where(left > j, padded[j : j + n], 0) for j in range(WINDOW)], bits)
    order = np.lexsort(numbers[::-1])
    keys = np.ascontiguousarray(np.stack([x[order] for x in numbers], 1).astype(">i8")).view(f"S{8 * len(numbers)}").ravel()
    return order, keys


MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("words", T.IntegerType())])
_ARROW_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])


def shard_matches(test: TestSuffixes, words: np.ndarray, begin: np.ndarray) -> dict[int, list[dict]]:
    """The longest verbatim matches of each text of a shard, by the text's number."""
    window, place = test.search(words, begin)
    if not len(window):
        return {}
    text = np.searchsorted(begin, place, side="right") - 1
    item, start, size = (x[window].astype(np.int64) for x in (test.item, test.start, test.size))
    local = place - begin[text]
    order = np.lexsort((start, local - start, item, text))
    text, item, start, size, local = text[order], item[order], start[order], size[order], local[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (local[1:] - start[1:] != local[:-1] - start[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    found: dict[int, list[dict]] = {}
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        found.setdefault(int(text[f]), []).append({"item_id": test.names[item[f]], "item_word": int(start[f]), "doc_word": int(local[f]), "words": int(start[e] + size[e] - start[f])})
    return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of ``most`` bytes of text (or one item)."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    block, held = [], 0
    for r in items.toLocalIterator():
        size = len(r["t"].encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += size
    if block:
        yield block


def find_matches(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words and matches: item, its first word, the document's first word, length in words."""
    names = [c for c in docs.columns if c not in ("n_words", "matches") or c == text]
    work = fresh(docs, "_text")
    spark = docs.sparkSession
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(work), F.lit(0).cast("long").alias("n_words"), F.array().cast(T.ArrayType(MATCH)).alias("matches"))
    schema = out.schema
    at = len(names)

    def step(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, at, SHARD_BYTES):
                words, begin = words_of(*text_buffers(b.column(at)))
                found = shard_matches(test.value, words, begin) if test is not None else {}
                matches = b.column(at + 2).to_pylist()
                for i, more in found.items():
                    matches[i] = matches[i] + more
                yield pa.RecordBatch.from_arrays([*b.columns[: at + 1], pa.array(np.diff(begin), pa.int64()), pa.array(matches, pa.list_(_ARROW_MATCH))], names=b.schema.names)
            release()

        return run

    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block, shared = next(blocks, None), None
    while block is not None:
        shared, after = spark.sparkContext.broadcast(TestSuffixes(block)), next(blocks, None)
        out = bounded(out).mapInArrow(step(shared), schema)
        if after is not None:
            out = cut(out)
            shared.destroy()
        block = after
    return (out if shared else bounded(out).mapInArrow(step(None), schema)).drop(work)


def leak_report(docs: DataFrame, key: str, text: str, benchmark: DataFrame, least: int = 2) -> DataFrame:
    """For each document: words, words inside matches, items found, their digest, and whether ``least`` items are found."""
    found = find_matches(docs.select(key, text), text, benchmark)
    ordered = F.array_sort("matches", lambda a, b: F.when(a["doc_word"] < b["doc_word"], -1).when(a["doc_word"] > b["doc_word"], 1).otherwise(0))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc, m):
        end = m["doc_word"] + m["words"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], m["doc_word"]))).alias("n"))

    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        key,
        "n_words",
        F.aggregate(ordered, zero, cover)["n"].alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= least).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, text: str, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold any window of any item."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return find_matches(rows, "text", benchmark).where(F.size("matches") == 0).select("row.*")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_W}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_W}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[s : s + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM i, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(s) WHERE len(w) >= n),
h AS (SELECT k, s, iw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM h, unnest(generate_series(s, s + n - 1)) AS t(p) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)"""
