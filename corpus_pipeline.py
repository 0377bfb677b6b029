"""From raw documents to token ids: language ID, line dedup, near-dedup, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages before the last return the columns of
``documents``. ``run`` writes every stage's result to the shared scratch folder and hands it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from barloom.llm import linedup, mixing, ppm, shingles, spm
from barloom.llm.common import small_batches, stored, table

#: A document is rejected if its language is unknown or told with a lower posterior than this.
LEAST_CERTAIN = 0.5
MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which takes the place of the column ``lang``; learnt from two thirds of the labelled rows."""
    small_batches(spark)
    trees = ppm.train(docs.where(~ppm.held_out("doc_id")))
    # The row goes through as one column, so that no name can clash.
    told = ppm.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), trees, keep=("row",))
    kept = told.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN))
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of lines of an earlier document; documents that lose every word go."""
    small_batches(spark)
    short = linedup.dedup_lines(docs)
    left = (F.col("deleted_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return short.where(left).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, 0.8); one of repeated rows. Documents without an id stay.

    SimHash links come first, MinHash keys find what two bits miss, and the exact similarity decides.
    Rows are repeated if id and text are equal; different texts of one id are documents of their own.
    """
    small_batches(spark)
    groups = shingles.near_copies(docs)
    lost = groups.where(F.col("doc_id").isNotNull() & ~F.col("first")).select("doc_id", F.col("text_hash").alias("hash")).distinct()
    # The row goes along as one column, so that no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(lost, ["doc_id", "hash"], "left_anti")
    again = groups.where("first").groupBy("doc_id", F.col("text_hash").alias("hash")).count().where("count > 1").drop("count")
    if not again.isEmpty():
        one = kept.join(again, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.min("row").alias("row"))
        kept = kept.join(again, ["doc_id", "hash"], "left_anti").unionByName(one.select(*kept.columns))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, block by block in the order of the mix."""
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange("block", "slot").sortWithinPartitions("block", "slot").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    small_batches(spark)
    return spm.encode_documents(docs, public_tokenizers.path(MODEL), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Context trees, alignments and pieces can't be said in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
