"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, fingerprints, hashing_search, merkle, order_minhash, packing, sentence_spans, sharding, suffix_dedup,
    token_counts, toxicity, whitening, wrapper,
)
from .common import table

TOKENIZERS = os.environ.get("MILLWRIGHT_TOKENIZERS")
"""Folder of the vocabulary files; unset: where the installed package of public tokenizers has them."""


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.shard(rows, ["doc_id"], 8, 9, size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_spans(docs, grow=True).select("doc_id", "n_sentences", "n_removed", "text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(cut)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_search.nearest(table(spark, sf_dir, "embeddings"))


def op13_merkle_multiproofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jump_shards, op2_decontamination, op3_toxicity, op4_sentence_spans, op5_best_fit_packing, op6_token_counts,
        op7_wrapper_text, op8_order_minhash, op9_iblt_fingerprints, op10_suffix_dedup, op11_bit_sliced_whitening,
        op12_multi_index_hashing, op13_merkle_multiproofs,
    )
}
ORACLES: dict[str, str] = {"op13_merkle_multiproofs": merkle.ORACLE}
