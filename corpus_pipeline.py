"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing to target weights, pieces.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it as Parquet to the shared folder and reads it back
as the next stage's docs, so a lost executor costs no more than the stage it was in. All stages but the last return the
columns of docs. Nulls, empty texts, repeated rows and empty tables are handled as the operators' docstrings say.

SQL can't state the near-duplicate and piece stages; run() is tested against a brute-force version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm import op4_pieces, op6_quality, op7_mix, op8_pii, op10_near
from tarifold.llm.queries import KEY
from tarifold.llm.shared import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return op6_quality.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates."""
    return op10_near.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars follows the text."""
    return op8_pii.pseudonymise(docs, KEY).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics."""
    return op7_mix.sample(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return op4_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
