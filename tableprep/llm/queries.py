"""Queries over the test tables, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import (
    ann, decontaminate, filter_audit, line_dedup, mixing, ngram_join, oracles, pii, secret_scan, sharding, suffix_dedup,
    token_counts, toxicity, vector_codes,
)
from tableprep.llm.common import plain_spans, read, span_list

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = plain_spans(*secret_scan.BASE)
    return secret_scan.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(plain_spans(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(plain_spans(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(span_list(plain_spans(*pii.KINDS)), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


@query()
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"))


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(read(spark, sf_dir, "documents"))


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), digest=True)


@query(oracles.VECTOR_CODES)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(oracles.FILTER_AUDIT)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["pipeline"] = corpus_pipeline.run
