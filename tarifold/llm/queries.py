"""Registered queries of the document operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarifold.llm import op1_phrases, op2_hmm, op3_licences, op4_pieces, op5_compression, op6_quality, op7_mix, op8_pii, op9_tokens, op10_near, op11_jaccard, op12_whitening, op13_codes
from tarifold.llm.shared import fresh_path

#: Key of the pseudonyms in the registered query; a user of the operator passes a secret of their own.
KEY = "documents-2024"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_phrases.fingerprints(table(spark, sf_dir))


@query("op2_language_model")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_hmm.score(table(spark, sf_dir))


@query("op3_licences")
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return op3_licences.scan(docs, op3_licences.fit(docs))


@query("op4_pieces")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op4_pieces.encode(table(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "piece_ids", "piece_crc32", "round_trip")


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return op5_compression.classify(docs, op5_compression.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_quality_rules", op6_quality.oracle())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = op6_quality.measure(table(spark, sf_dir), "doc_id", "lang", "source")
    return op6_quality.verdicts(counts).select("doc_id", *op6_quality.COUNTS, "base_failed", "kept")


@query("op7_mix_sources", op7_mix.oracle())
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op7_mix.decided(table(spark, sf_dir))
    return rows.selectExpr("doc_id", "_topic AS topic", "_tokens AS tokens", "probability", "sampled")


@query("op8_pseudonyms")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii.pseudonymise(table(spark, sf_dir).select("doc_id", "text"), KEY)


@query("op9_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    files = op9_tokens.write_tokens(table(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return op9_tokens.read_tokens(spark, folder, files)


@query("op10_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_near.classes(table(spark, sf_dir))


@query("op11_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_jaccard.join_components(table(spark, sf_dir))


@query("op12_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_vector_codes")
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_codes.compress(table(spark, sf_dir, "embeddings"))
