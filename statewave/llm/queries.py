"""The operators over whole tables with production parameters, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statewave.llm.html_text import extract
from statewave.llm.langid import language_digest
from statewave.llm.mixing import mix_digest
from statewave.llm.ngram_join import join_digest
from statewave.llm.ngram_lm import lm_digest
from statewave.llm.packing import pack
from statewave.llm.phrases import phrases
from statewave.llm.pii import pii_digest
from statewave.llm.quality_fm import quality_digest
from statewave.llm.quality_rules import rules_digest
from statewave.llm.repair import ids_digest
from statewave.llm.resample import resample_digest
from statewave.llm.vptree import vector_digest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii_digest(table(spark, d, "documents"))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mix_digest(table(spark, d, "documents"))


def op3_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return join_digest(table(spark, d, "documents"))


def op4_langid(spark: SparkSession, d: str) -> DataFrame:
    return language_digest(table(spark, d, "documents"))


def op5_html_text(spark: SparkSession, d: str) -> DataFrame:
    return extract(table(spark, d, "pages"))


def op6_quality_fm(spark: SparkSession, d: str) -> DataFrame:
    return quality_digest(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules_digest(table(spark, d, "documents"))


def op8_ngram_lm(spark: SparkSession, d: str) -> DataFrame:
    return lm_digest(table(spark, d, "documents"))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def op10_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vector_digest(table(spark, d, "embeddings"))


def op11_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases(table(spark, d, "documents"))


def op12_resample(spark: SparkSession, d: str) -> DataFrame:
    return resample_digest(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_token_files(spark: SparkSession, d: str) -> DataFrame:
    return ids_digest(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii, op2_mixing, op3_ngram_join, op4_langid, op5_html_text, op6_quality_fm, op7_quality_rules, op8_ngram_lm,
    op9_packing, op10_nearest, op11_phrases, op12_resample, op13_token_files)}
