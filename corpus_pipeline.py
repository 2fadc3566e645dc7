"""Documents to training sequences: rules, near duplicates, personal data, mixing, packing.

Each stage is a function of (spark, docs, sf_dir). Its rows are written as Parquet and read again
as the next stage's documents; all but the last have the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewave.llm.mixing import mix
from statewave.llm.ngram_join import keep_one
from statewave.llm.packing import pack
from statewave.llm.pii import mask_pii
from statewave.llm.quality_rules import keep_good
from statewave.llm.store import saved
from statewave.llm.text import plain


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked and their lengths brought up to date."""
    masked = plain(mask_pii(docs))
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return masked.toDF(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed sequence: a document read twice is there twice, one read in part is cut."""
    return mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("near duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Byte-pair encoding has no SQL counterpart; the whole run is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
