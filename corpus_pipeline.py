"""A corpus pipeline of five stages; each calls one operator on all rows that the stage before it kept.

Null and empty texts pass every stage unless the classifier rejects them: they
have no lines to remove, no group, and no window. A null doc_id comes after all
others where rows are ordered; rows with one doc_id are one document for near
duplicates only. Repeated rows are treated alike, so they stay or go together,
but for the near duplicates, which keep one. Other columns, whatever their names,
are carried along. Empty tables give empty results; without labels nothing is
learned and the classifier's prior decides.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, lines, neardup, quality
from millrace.llm.common import load, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, load(spark, sf_dir, "labels"), "quality", (3, 1))
    return quality.accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred before go; n_chars follows the text."""
    return lines.dedup(docs, runs=True).withColumn("n_chars", F.char_length("text").cast("bigint"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded; the digests remain."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result stored before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
