"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import fingerprint, hard_negatives, id_files, language_id, line_dedup, lm_score, mixing, near_dup, packing, piece_codec, quality, token_count, whitening
from panelkit.llm.common import crc_mod, documents
from panelkit.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_limits(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir), [3, 1, 2], 1.5, 2)


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.encode_to_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir), fingerprint.FAR)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return lm_score.score_documents(documents(spark, sf_dir), held_out, public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), crc_mod(F.col("doc_id"), 5) == 0)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), 3, 85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "text", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), "n_links")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_token_counts, op2_quality_rules, op3_source_mixing, op4_token_id_files, op5_fingerprints, op6_packing, op7_lm_scores, op8_language_id, op9_near_duplicates, op10_line_dedup, op11_piece_codec, op12_hard_negatives, op13_whitening, pipeline]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
