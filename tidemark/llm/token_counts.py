"""Token counts of whole texts, by Arrow functions that return lengths only.

A SentencePiece BPE model joins two neighbouring characters only inside a piece. Where no piece of the
vocabulary holds a pair of neighbours, no piece can span it, and the text may be cut there without
changing the count. (Unigram models are given whole texts: the library sums scores in single precision
along the text, so that what is far away can decide a near tie.) A space after a non-space is such a place in usual models;
this is read off the vocabulary, not assumed. Texts are cut there into words, each distinct word of
a batch is encoded once (a bounded cache keeps counts across batches), and words longer than
``LONG`` characters are cut again at other safe pairs. Batches hold about ``BATCH_BYTES`` of text,
so one very long text is a batch alone and short ones share one.

A tokenizers file (``.json``) counts each whole text in one call.

Defined results: a null text counts as empty, 0 tokens. Repeated rows are counted each. An empty table
gives an empty one. A column of the input that clashes with the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, by_bytes, fresh, release

BATCH_BYTES = 1 << 20
LONG = 4_096
CACHE_WORDS, CACHE_CHARS = 600_000, 8 << 20
MARK = "▁"  # how the library writes a space
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


class Counter:
    """Counts of one SentencePiece model, safe places included. One for each Python worker and model."""

    def __init__(self, path: str, bpe: bool | None = None):
        import sentencepiece

        if bpe is None:
            from tidemark.llm.sentencepieces import BPE, parse_model

            with open(path, "rb") as f:  # the library's own file, on every machine
                bpe = parse_model(f.read()).kind == BPE

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i) and not self.model.is_byte(i)]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        one, none = (len(x) for x in self.model.encode(["a a", ""], num_threads=1))
        plain = self.model.encode([" a", "a"], num_threads=1)  # a dummy prefix, and spaces are kept
        self.words = bpe and not any(p[1] == MARK and p[0] != MARK for p in self.pairs) and none == 0 and len(plain[0]) > len(plain[1]) and one == 2 * len(plain[1])
        self.stop = "\n" if bpe and not any("\n" in p for p in self.pairs) else None
        self.stop_cost = len(self.model.encode("\n")) if self.stop else 0
        self.known: dict[str, int] = {}
        self.chars = 0  # in known

    def split(self, text: str) -> list[str]:
        """Words whose counts add up to the text's."""
        if not self.words or not text:
            return [text]
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        runs = _RUNS.findall(MARK + text.replace(" ", MARK))
        if runs[-1] == MARK and len(runs) > 1:  # a last single space is no word of its own
            runs[-2:] = [runs[-2] + MARK]
        return [run[1:] for run in runs]

    def cuts(self, word: str) -> list[str]:
        """A long word in parts: all but the first begin with the stop character, whose cost is taken off again."""
        parts, at, n = [], 0, len(word)
        flat = word.replace(" ", MARK)
        while n - at > LONG:
            i = at + LONG // 2
            while i < n and (flat[i - 1 : i + 1] in self.pairs or self.stop + flat[i] in self.pairs):
                i += 1
            if i >= n:
                break
            parts.append(word[at:i])
            at = i
        parts.append(word[at:])
        return [parts[0], *(self.stop + p for p in parts[1:])]

    def learn(self, words: set[str]) -> None:
        todo, known = [w for w in words if w not in self.known], self.known
        self.chars += sum(map(len, todo))
        long = [w for w in todo if len(w) > LONG and self.stop]
        short = [w for w in todo if not (len(w) > LONG and self.stop)]
        for i in range(0, len(short), 50_000):
            some = short[i : i + 50_000]
            known.update(zip(some, map(len, self.model.encode(some, num_threads=1)), strict=True))
        for w in long:
            parts = self.cuts(w)
            known[w] = sum(map(len, self.model.encode(parts, num_threads=1))) - self.stop_cost * (len(parts) - 1)

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [sum(map(known.__getitem__, ws)) for ws in split]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _tokenizer_counts(path: str, texts: list[str | None]) -> list[int]:
    """For a tokenizers file: whole texts, special strings as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [len(e.ids) for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


def count_tokens(df: DataFrame, text: str, resolve: Callable[[], str], out: str = "n_tokens", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df`` with column ``out``: the tokens of each whole text. ``resolve`` gives the model's path where it runs."""
    kept = df.drop(out)
    work = fresh(kept, "_text")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.LongType())])
    names, at = kept.columns, len(kept.columns)
    kept = kept.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(work)) if text in names else df.select(*names, F.col(f"`{text}`").alias(work))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = resolve()
        for b in by_bytes(batches, at, batch_bytes):
            texts = b.column(at).to_pylist()
            n = counter(path).count(texts) if path.endswith(".model") else _tokenizer_counts(path, texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(n, pa.int64())], names=[*names, out])
        release()

    return bounded(kept).mapInArrow(run, schema)


def public_model(name: str) -> Callable[[], str]:
    """The path of a public tokenizer's file, found where the function runs."""

    def resolve() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return resolve
