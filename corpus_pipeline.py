"""A corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

Defined results of the stages, beside those of their operators: columns that ``documents`` doesn't name go
along unchanged, whatever they are called (the last stage leaves them out); repeated rows are judged
alike, and of exact copies of a row one stays (``one_of_each_group``); very long texts are read whole by every stage; an empty table
passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, pii, sentencepieces, setjoin
from tidemark.llm.common import cut, table
from tidemark.llm.queries import PIECES


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), or without one language for half of them, go.

    A null ``lang`` is not learned from; if no document has one, nothing can be told apart and all go.
    """
    return langid.keep_known(docs, "doc_id", "text", "lang")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays.

    Documents without an id all stay, as do those without words. An id that repeats with one text stays once; with
    several texts it stays with all of them if one is to stay.
    """
    return setjoin.keep_one(docs, "doc_id", "text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of a benchmark item (or a whole shorter one) go; null texts stay."""
    return decontaminate.remove_leaks(docs, "text", table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows. A null text stays null, with a null n_chars."""
    return pii.mask_pii(docs, "text").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text by the rebuilt tokenizer, whether they are the library's, and whether they decode to the text.

    A null text has no ids.
    """
    return sentencepieces.round_trip(docs.select("doc_id", "lang", "source", "text"), "text", PIECES).drop("text")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


#: Language ID is learned and cannot be written in SQL; the pipeline is tested against brute-force stages.
ORACLE_SQL = None
