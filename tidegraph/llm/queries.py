"""Registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import bpe, chat, html, langid, neardup_text, neardup_vectors, packing, substrings, topk, toxicity
from tidegraph.llm.common import table
from tidegraph.llm.oracles import ORACLES


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of ids and decoded bytes of every document."""
    out = bpe.encode(table(spark, sf_dir, "documents"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.remainder("doc_id", 4) != 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", (langid.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labelled documents whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(langid.remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision of every embedding."""
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation, and conversation -7, which says control strings."""
    own = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(probe)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many an earlier document already has, and a digest of the others."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every packed document."""
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return neardup_text.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every query vector."""
    return topk.topk(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_byte_bpe, op2_language_id, op3_html_text, op4_toxicity, op5_vector_near_dedup, op6_chat_format, op7_substring_dedup, op8_packing, op9_ngram_jaccard, op10_exact_topk]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can say it; tokenising, models and page trees are held against libraries and brute force in the tests."""
    return dict(ORACLES)
