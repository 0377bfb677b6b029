"""The registered queries of this package, with their answers in SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bitplanes, hmm, html, linedup, mixing, nndescent, packing, ppm, quality, simhash, spm, tries, variants
from barloom.llm.common import small_batches, table

Plan = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    short = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return short.select("doc_id", "text", "deleted_lines")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ppm.label_documents(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block", "slot", "weight")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spm.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_bit_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bitplanes.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return variants.spelling_variants(table(spark, sf_dir, "documents"), misspelt=199)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"), family=tries.FAMILY)


QUERIES: dict[str, Plan] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_bit_plane_output": op7_bit_plane_output,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_hidden_markov_scores": op9_hidden_markov_scores,
    "op10_quality_rules": op10_quality_rules,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL: dict[str, str] = {"op10_quality_rules": quality.sql()}
