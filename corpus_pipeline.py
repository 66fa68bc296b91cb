"""A training-corpus pipeline: five stages over the documents table.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet
and read again as the next stage's ``docs``.

Edge cases: documents without text, letters or words go in the first two stages; null ids are
rows of their own and stay; rows that repeat id and text are reduced to one with the near
duplicates, unlike texts of a repeated id are documents of their own; columns besides those of documents are kept as they are, whatever their names;
an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import language_id, line_dedup, mixing, near_dup, packing
from panelkit.llm.common import crc_mod, documents, new_path

#: A document whose main language has less than this share is rejected.
LEAST_SHARE = 0.5
#: A column of the language stage alone.
TOLD = "__language_stage"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known main language; others go.  A missing language is filled in."""
    model = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    told = language_id.with_prediction(docs, model, TOLD)
    sure = (F.col(f"{TOLD}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{TOLD}.score") >= LEAST_SHARE)
    return told.where(sure).withColumn("lang", F.coalesce("lang", f"{TOLD}.lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those left without a word go."""
    out = line_dedup.dedup_lines(docs, counts=False).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words a shingle, similarity 0.8."""
    return near_dup.one_of_each(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 3, 1, 2 over sources, 150 % of all words."""
    return mixing.mix(docs, [3, 1, 2])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Mixture inference and packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
