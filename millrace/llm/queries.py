"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, langid, lines, neardup, ordermin, pii, pitman, quality, substring
from millrace.llm.common import load, remainder
from millrace.llm.sql import ORACLE

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_pitman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pitman.score(load(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.report(load(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, load(spark, sf_dir, "labels"), "quality", (3, 1))
    return quality.scored(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(load(spark, sf_dir, "documents"), size=4).drop("key")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find(load(spark, sf_dir, "documents")).drop("removed")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(load(spark, sf_dir, "documents"), runs=True)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(remainder("doc_id", 5) != 0))
    out = langid.identify(docs.drop("lang"), model, spans=False)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(load(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pitman, op2_ordermin, op3_quality, op4_neardup, op5_substring, op6_lines, op7_bpe, op8_langid, op9_pii, op10_decontaminate)
    return {f.__name__: f for f in (pipeline, *ops)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
