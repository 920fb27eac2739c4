"""The registered queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, langid, pii, repeats, sentencepieces, setjoin, token_counts, url_filter, vafile
from tidemark.llm.common import table

PIECES = token_counts.public_model("piece_bpe_32k.model")
MOST_TOKENS = 4_096


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.round_trip(docs, "text", PIECES, keep_ids=False).drop("text")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, "url", url_filter.default_rules()).drop("url")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = token_counts.count_tokens(docs, "text", PIECES)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MOST_TOKENS).alias("over_limit"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    marked = langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), "text", model)
    return marked.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(chat.format_chats(turns.unionByName(chat.probe(turns))))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_exact_topk, op3_decontamination, op4_sentencepiece, op5_url_filter, op6_token_counts, op7_language_id, op8_pii, op9_chat_format, op10_suffix_dedup)}
ORACLE_SQL = {
    "op1_ngram_jaccard": setjoin.ORACLE,
    "op2_exact_topk": vafile.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_suffix_dedup": repeats.ORACLE,
}
