"""Language of whole texts: script ranges, word scores, and a Viterbi path over the words.

Fitting counts hashed letter bigrams and trigrams (word edges included) for each language, and how
the language's letters fall into scripts, over at most about ``FIT_DOCS`` labelled documents of each
language, chosen by a hash of the id; counts are summed in Spark, ``BUCKETS`` + scripts for each
language at most reach the driver. At most ``MOST_LANGS`` languages are learned, those with the most
documents (ties: that sort first): 128 KB of the model each, so that its broadcast has a bound.

Predicting: a word's script leaves those languages that use it; each gets the word's log-likelihood;
the best path over the words, with a penalty for each switch, labels spans of one language. The path
is found in blocks of ``BLOCK`` words at once: a block's best scores from every entering to every
leaving language form a small matrix, the matrices are chained, and a second pass reads the path. Texts of up to
a block need no matrices. No array of the search has over about ``CELLS`` numbers, whatever the texts.

The text's language is that of the most letters; its score is their share.

Defined results: a text that is null or has no letters is ``und`` with score 0 and no spans, as are
all texts if there was nothing to learn from; ties go to the language that sorts first; repeated rows
are labelled each; a very long text is searched whole, as one path; an empty table gives an empty one;
columns of the input that clash with the results are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, by_bytes, fresh, release

FIT_DOCS = 2_000
MOST_LANGS = 1_024
BUCKETS = 1 << 15
SWITCH = 14.0
BLOCK = 64
CELLS = 1 << 21
BATCH_BYTES = 1 << 19
UNKNOWN = "und"
ALPHA = 0.5
RARE = 0.005  # a language uses a script that holds this share of its letters

#: First code point of each script's ranges. Fixed values of the Unicode blocks.
_SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x30000, "other")]
SCRIPTS = sorted({s for _, s in _SCRIPTS})
_FROM = np.array([a for a, _ in _SCRIPTS])
_KIND = np.array([SCRIPTS.index(s) for _, s in _SCRIPTS])

_LETTERS: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case if that is one character."""
    if not _LETTERS:
        _LETTERS[:] = [
            np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000),
            np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), dtype=np.uint32, count=0x110000),
        ]
    return _LETTERS[0], _LETTERS[1]


@dataclass
class Words:
    """The words of a batch: hashed n-grams of each letter, spans, scripts, and each text's first word."""

    grams: np.ndarray  # [letters, 2]
    begin: np.ndarray  # first letter of each word, in grams
    size: np.ndarray
    start: np.ndarray  # code points, in the text
    script: np.ndarray
    first: np.ndarray  # [texts + 1]


def split_words(texts: list[str | None]) -> Words:
    letter, lower = _letters()
    codes = np.frombuffer(" ".join([x or "" for x in texts] + [""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x or "") + 1 for x in texts], out=offsets[1:])
    is_letter = letter[codes]
    before = np.concatenate(([False], is_letter[:-1])) if len(codes) else is_letter
    starts = np.flatnonzero(is_letter & ~before)
    at = np.flatnonzero(is_letter)
    begin = np.searchsorted(at, starts)
    size = np.diff(np.append(begin, len(at)))
    flat = np.where(is_letter, lower[codes], np.uint32(32)).astype(np.uint64) if len(codes) else codes.astype(np.uint64)
    c0 = flat[at]
    c1 = np.where(at > 0, flat[np.maximum(at - 1, 0)], 32)
    c2 = np.where((at > 1) & (c1 != 32), flat[np.maximum(at - 2, 0)], 32)
    after = np.where(at + 1 < len(flat), flat[np.minimum(at + 1, max(len(flat) - 1, 0))], 32)
    mix = lambda h: ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    two = mix(c1 * np.uint64(0x100000001B3) + c0 + np.uint64(1))
    three = mix(c2 * np.uint64(0x10000000233) + c1 * np.uint64(0x8CB92BA72F3D8DD7) + c0 * np.uint64(0x2545F4914F6CDD1D) + np.where(after == 32, 7, 0).astype(np.uint64))
    script = _KIND[np.searchsorted(_FROM, codes[starts].astype(np.int64), side="right") - 1]
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(np.stack([two, three], 1).astype(np.int64), begin, size, starts - offsets[text], script, first)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # [buckets, languages]
    uses: np.ndarray  # [scripts, languages]


def _came(x: np.ndarray, enter: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words x [words, rows, languages]: the language before each word's, and the best scores at the end."""
    steps, rows, k = x.shape
    came = np.empty((steps, rows, k), dtype=np.uint16)
    v, own, every = enter, np.arange(k, dtype=np.uint16), np.arange(rows)
    for t in range(steps):
        j = v.argmax(1)
        alt = v[every, j][:, None] - penalty
        came[t] = np.where(alt > v, j[:, None].astype(np.uint16), own)
        v = np.maximum(v, alt) + x[t]
    return came, v


def _short(scores: np.ndarray, first: np.ndarray, last: np.ndarray, penalty: float, label: np.ndarray) -> None:
    """Texts of up to ``BLOCK`` words, those of one length together, ``CELLS`` scores at a time."""
    k = scores.shape[1]
    order = np.argsort(last - first, kind="stable")
    size = (last - first)[order]
    at = 0
    while at < len(order):
        n = int(size[at])
        end = min(int(np.searchsorted(size, n, side="right")), at + max(1, CELLS // (n * k)))
        words = first[order[at:end]][None, :] + np.arange(n)[:, None]
        came, v = _came(scores[words], np.zeros((end - at, k), dtype=np.float32), penalty)
        state = v.argmax(1)
        for t in range(n - 1, -1, -1):
            label[words[t]] = state
            state = came[t, np.arange(end - at), state]
        at = end


def _long(scores: np.ndarray, first: np.ndarray, last: np.ndarray, penalty: float, label: np.ndarray) -> None:
    """Texts in blocks of ``BLOCK`` words, so many blocks at a time that no array has over about ``CELLS`` numbers."""
    k = scores.shape[1]
    per = -(-(last - first) // BLOCK)
    of = np.repeat(np.arange(len(per)), per)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    start, stop, ends = first[of] + rank * BLOCK, last[of], rank == per[of] - 1
    nothing = np.zeros((1, k), dtype=scores.dtype)
    some = max(1, CELLS // (k * max(k, BLOCK)))
    pieces = [slice(a, min(a + some, len(of))) for a in range(0, len(of), some)]

    def taken(s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = start[s][None, :] + np.arange(BLOCK)[:, None]
        real = at < stop[s][None, :]
        x = scores[np.where(real, at, 0)]
        x[~real] = 0
        return at, real, x

    def ranks(s: slice) -> list[np.ndarray]:
        """The piece's blocks by their place in its runs of one text."""
        n = s.stop - s.start
        opens = rank[s] == 0
        opens[0] = True
        place = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        return np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])

    enter = np.zeros((len(of), k), dtype=np.float32)
    carry = nothing[0]
    for s in pieces:  # forward: each block's best scores from every entering to every leaving language
        _, _, x = taken(s)
        m = np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-np.inf))[None].repeat(s.stop - s.start, 0)
        for t in range(BLOCK):
            m = np.maximum(m, m.max(2, keepdims=True) - penalty) + x[t][:, None, :]
        own = enter[s]
        if rank[s.start]:
            own[0] = carry
        for b in ranks(s)[1:]:
            own[b] = (own[b - 1][:, :, None] + m[b - 1]).max(1)
            own[b] -= own[b].max(1, keepdims=True)
        carry = (own[-1][:, None] + m[-1]).max(0)
        carry -= carry.max()
    entered = 0  # the language in which the block behind a piece is entered
    for s in reversed(pieces):  # backward: the path to every leaving language, then the one that is taken
        at, real, x = taken(s)
        n = s.stop - s.start
        came, v = _came(x, enter[s], penalty)
        path = np.empty((BLOCK, n, k), dtype=np.uint16)
        state = np.broadcast_to(np.arange(k, dtype=np.uint16), (n, k))
        for t in range(BLOCK - 1, -1, -1):
            path[t] = state
            state = np.take_along_axis(came[t], state, 1)
        leave = v.argmax(1)
        if not ends[s.stop - 1]:
            leave[-1] = entered
        for b in ranks(s)[:0:-1]:
            leave[b - 1] = state[b, leave[b]]
        label[at[real]] = path[:, np.arange(n), leave][real]
        entered = int(state[0, leave[0]])


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; ``first``: where each text's words begin."""
    n, k = scores.shape
    label = np.zeros(n, dtype=np.int64)
    if not n or k == 1:
        return label
    a, b = first[:-1], first[1:]
    for some, way in (((b > a) & (b - a <= BLOCK), _short), (b - a > BLOCK, _long)):
        if some.any():
            way(scores, a[some], b[some], np.float32(penalty), label)
    return label


def word_scores(model: Model, w: Words) -> np.ndarray:
    """[words, languages]: log-likelihood, far below for languages that don't use the word's script."""
    if not len(w.begin):
        return np.zeros((0, len(model.langs)), dtype=np.float32)
    letters = model.logp[w.grams[:, 0]] + model.logp[w.grams[:, 1]]
    scores = np.add.reduceat(letters, w.begin, axis=0)
    uses = model.uses[w.script]
    return np.where(uses | ~uses.any(1, keepdims=True), scores, scores.min() - np.float32(1_000)).astype(np.float32)


def label_texts(model: Model | None, texts: list[str | None], penalty: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Language, score and spans (language, start, end) of each text."""
    if model is None or not model.langs:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    w = split_words(texts)
    label = viterbi(word_scores(model, w), w.first, penalty)
    k, n = len(model.langs), len(texts)
    text = np.repeat(np.arange(n), np.diff(w.first))
    letters = np.bincount(text * k + label, weights=w.size, minlength=n * k).reshape(n, k)
    best, total = letters.argmax(1), letters.sum(1)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(text)) - 1 if len(begin) else begin
    spans: list[list] = [[] for _ in texts]
    for t, lang, s, e in zip(text[begin].tolist(), label[begin].tolist(), w.start[begin].tolist(), (w.start[last] + w.size[last]).tolist(), strict=True):
        spans[t].append((model.langs[lang], s, e))
    return [(model.langs[b], float(letters[i, b] / total[i]), spans[i]) if total[i] else (UNKNOWN, 0.0, []) for i, b in enumerate(best.tolist())]


def fit(docs: DataFrame, key: str, text: str, lang: str, most: int = FIT_DOCS) -> Model | None:
    """A model of the labelled rows of ``docs``: all of a language's up to about ``most``, else a share by hash of the key."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    most_common = labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGS)
    sizes = {r["l"]: r["n"] for r in most_common.collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    parts = 1 << 30
    shares = F.from_json(F.lit(json.dumps({x: min(parts, int(parts * most / sizes[x])) for x in langs})), "map<string,long>")
    share = F.coalesce(F.try_element_at(shares, F.col("l")), F.lit(0))
    sample = labelled.where(F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(7)), F.lit(parts)) < share).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BUCKETS + len(SCRIPTS)
        number = {x: i for i, x in enumerate(langs)}
        for b in by_bytes(batches, 0, BATCH_BYTES):
            w = split_words(b.column(0).to_pylist())
            of_text = np.array([number[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            word = of_text[np.repeat(np.arange(b.num_rows), np.diff(w.first))] * size
            letter = np.repeat(word, w.size)
            key, n = np.unique(np.concatenate([letter + w.grams[:, 0], letter + w.grams[:, 1], np.repeat(word + BUCKETS + w.script, w.size)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // size, pa.int32()), pa.array(key % size, pa.int32()), pa.array(n, pa.int64())], names=["l", "b", "n"])

    counted = bounded(sample).mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    totals[counted["l"], counted["b"]] = counted["n"]
    grams, scripts = totals[:, :BUCKETS], totals[:, BUCKETS:]
    logp = np.log((grams + ALPHA) / (grams.sum(1, keepdims=True) + ALPHA * BUCKETS)).T
    uses = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= RARE).T
    return Model(langs, np.ascontiguousarray(logp, dtype=np.float32), np.ascontiguousarray(uses))


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def predict(df: DataFrame, text: str, model: Model | None, penalty: float = SWITCH) -> DataFrame:
    """``df`` with lang_pred, score and lang_spans; columns of these names are replaced."""
    new = ("lang_pred", "score", "lang_spans")
    names = [c for c in df.columns if c not in new]
    work = fresh(df, "_text")
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", SPANS)])
    shared, at = df.sparkSession.sparkContext.broadcast(model), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at, BATCH_BYTES):
            found = label_texts(shared.value, b.column(at).to_pylist(), penalty)
            spans = [[{"lang": x, "start": s, "end": e} for x, s, e in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, _ARROW_SPANS)], names=[*names, *new])
        release()

    return bounded(df).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(work)).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, key: str, text: str, lang: str, least: float = 0.5) -> DataFrame:
    """``docs`` without texts of no language and those whose main language holds less than ``least`` of the letters."""
    model = fit(docs.where(~held_out(F.col(key))), key, text, lang)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, at, BATCH_BYTES):
            found = label_texts(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found], pa.bool_()))
        release()

    return bounded(docs).mapInArrow(run, docs.schema)
