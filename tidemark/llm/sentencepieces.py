"""SentencePiece models on the tokenizers library's backend: encode, decode, verify parity.

``parse_model`` reads the model's protobuf: pieces with scores and types, the normaliser, byte
fallback. ``backend`` rebuilds it as a tokenizer: the normaliser (a precompiled map if there is one,
extra spaces, the metaspace marker), a Unigram model with the scores, or for BPE models the merges
that the scores imply, with byte fallback.

A text of a BPE model is cut at places that no piece can span (see ``token_counts``; others stay whole),
its distinct words are encoded once by the backend in multithreaded batches of ``BATCH_WORDS``, and their ids are put together by
vectorised gathers. Every distinct word is also encoded by the sentencepiece library, and its ids are
decoded again by the backend's decoder: ``parity`` is whether all words of a text have the library's
ids, ``exact`` whether all come back as they were. A text's ids are always the backend's.

``decode`` takes any ids and gives them to the backend's decoder whole.

Defined results: a null text is an empty one, without ids; decoding gives the marker back as a space
and drops the dummy prefix; control pieces decode to nothing, the unknown piece to its name, and ids
outside the vocabulary raise; repeated rows are treated each; very
long texts are a batch of their own; columns of the input that clash with the results are replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, by_bytes, few_arenas, fresh, release
from tidemark.llm.token_counts import MARK, Counter

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
BATCH_BYTES = 1 << 20
CACHE_WORDS, CACHE_CHARS = 200_000, 4 << 20
BATCH_WORDS = 1 << 14
THREADS = 2


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or raw bytes of fixed and delimited fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire}")
            size = varint()
        if at + size > len(raw):
            raise ValueError("the message ends early")
        yield key >> 3, raw[at : at + size]
        at += size


def parse_model(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            got = dict(_fields(value))
            spec.kind, spec.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            spec.charsmap, spec.dummy_prefix = got.get(2, b""), bool(got.get(3, 1))
            spec.trim_spaces, spec.escape_spaces = bool(got.get(4, 1)), bool(got.get(5, 1))
    return spec


def backend(spec: Spec):
    """The tokenizers library's tokenizer for a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unk = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk, spec.byte_fallback)
    elif spec.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        usable = {p for p, _, k in spec.pieces if k in (NORMAL, USER)}
        merges = [(-s, i, p[:c], p[c:]) for i, (p, s, k) in enumerate(spec.pieces) if k == NORMAL for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
        merges.sort(key=lambda m: m[:2])
        model = models.BPE(vocab, [m[2:] for m in merges], unk_token=None if unk is None else spec.pieces[unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)
    else:
        raise ValueError(f"model type {spec.kind}: only unigram and BPE models have scores to rebuild")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_spaces else " "))
    if spec.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1 if spec.dummy_prefix else 0, 0)])
    user = [AddedToken(p, normalized=False, special=False) for p, _, k in spec.pieces if k == USER]
    if user:
        t.add_tokens(user)
    return t


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + sizes[i]``, one after the other."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class Codec:
    """One model in one Python worker: the rebuilt tokenizer, the library to hold it against, ids of known words."""

    def __init__(self, path: str, raw: bytes | None = None):
        if raw is None:
            with open(path, "rb") as f:  # the library's own file, on every machine
                raw = f.read()
        spec = parse_model(raw)
        self.tokenizer, self.cutter, self.size_of_vocabulary = backend(spec), Counter(path, spec.kind == BPE), len(spec.pieces)
        if spec.trim_spaces or not spec.dummy_prefix or not spec.escape_spaces or spec.charsmap:
            self.cutter.words = False  # such normalisers look across spaces: texts stay whole
        self.control = {i for i, p in enumerate(spec.pieces) if p[2] == CONTROL}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.start, self.size, self.same, self.back, self.seen = (np.zeros(0, dtype=t) for t in (np.int64, np.int32, bool, bool, np.int32))
        self.flat = np.zeros(0, dtype=np.int32)

    def forget(self) -> None:
        """Keep the words that several batches had, or none if those are many."""
        often = self.seen > 1
        words = [w for w, o in zip(self.known, often.tolist(), strict=True) if o]
        chars = sum(map(len, words))
        if len(words) > CACHE_WORDS * 3 // 4 or chars > CACHE_CHARS * 3 // 4:
            return self.clear()
        self.flat = self.flat[_ragged(self.start[often], self.size[often])]
        self.size, self.same, self.back = self.size[often], self.same[often], self.back[often]
        self.seen = np.ones(len(words), dtype=np.int32)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.known, self.chars = dict(zip(words, range(len(words)), strict=True)), chars

    def learn(self, words: list[str]) -> None:
        flat, size, same, back = [self.flat], [self.size], [self.same], [self.back]
        for i in range(0, len(words), BATCH_WORDS):
            some = words[i : i + BATCH_WORDS]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            library = self.cutter.model.encode(some, num_threads=1)
            again = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            size.append(np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)))
            same.append(np.fromiter(map(eq, ids, library), dtype=bool, count=len(ids)))
            back.append(np.fromiter((a == w.replace(MARK, " ") for a, w in zip(again, some, strict=True)), dtype=bool, count=len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size[-1].sum())))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.chars += sum(map(len, words))
        self.flat, self.size, self.same, self.back = (np.concatenate(x) for x in (flat, size, same, back))
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.seen = np.concatenate([self.seen, np.zeros(len(words), dtype=np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each text's first, and whether each text's are the library's and come back as the text."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        split = [self.cutter.split(t) if t else [] for t in texts]
        if todo := list(set().union(*split).difference(self.known)):
            self.learn(todo)
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        self.seen += np.bincount(word, minlength=len(self.seen)) > 0
        n = np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)])
        size = self.size[word]
        ids = self.flat[_ragged(self.start[word], size)]
        summed = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[n]
        return ids, summed(size), np.diff(summed(~self.same[word])) == 0, np.diff(summed(~self.back[word])) == 0

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The text of each list of ids, by the backend's decoder."""
        seen = set(chain.from_iterable(ids))
        if any(i is None or not 0 <= i < self.size_of_vocabulary for i in seen):
            raise ValueError("an id outside the vocabulary")
        if seen & self.control:
            ids = [[i for i in x if i not in self.control] for x in ids]
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        few_arenas()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, text: str, resolve: Callable[[], str], out: str = "ids") -> DataFrame:
    """``df`` with ``out``, the ids of each whole text, and ``parity``: whether the rebuilt tokenizer gave them."""
    names = [c for c in df.columns if c not in (out, "parity")]
    work, at = fresh(df, "_text"), len(names)
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField("parity", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = resolve()
        for b in by_bytes(batches, at, BATCH_BYTES):
            ids, begin, same, _ = codec(path).encode(b.column(at).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], lists, pa.array(same)], names=[*names, out, "parity"])
        if path in _CODECS:
            _CODECS[path].clear()
        release()

    return bounded(df).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(work)).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, resolve: Callable[[], str], out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of each array of ids (null: empty)."""
    names = [c for c in df.columns if c != out]
    work, at = fresh(df, "_ids"), len(names)
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = resolve()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = codec(path).decode([x or [] for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string())], names=[*names, out])
        release()

    return bounded(df).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias(work)).mapInArrow(run, schema)


def round_trip(df: DataFrame, text: str, resolve: Callable[[], str], keep_ids: bool = True) -> DataFrame:
    """``df`` with n_tokens, ids (or their digest), parity and exact: whether the decoded words are the text's, markers as spaces."""
    names = [c for c in df.columns if c not in ("n_tokens", "ids", "ids_sha256", "parity", "exact")]
    work, at = fresh(df, "_text"), len(names)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())) if keep_ids else T.StructField("ids_sha256", T.StringType()), T.StructField("parity", T.BooleanType()), T.StructField("exact", T.BooleanType())]
    schema = T.StructType([*(df.schema[c] for c in names), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        path = resolve()
        for b in by_bytes(batches, at, BATCH_BYTES):
            ids, begin, same, exact = codec(path).encode(b.column(at).to_pylist())
            if keep_ids:
                kept = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            else:
                data, at_byte = ids.astype("<i4").tobytes(), (begin * 4).tolist()
                kept = pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at_byte[:-1], at_byte[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(np.diff(begin), pa.int64()), kept, pa.array(same), pa.array(exact)], names=schema.names)
        if path in _CODECS:
            _CODECS[path].clear()
        release()

    return bounded(df).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(work)).mapInArrow(run, schema)
