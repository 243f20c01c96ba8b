"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunk_dedup, decontamination, exact_dedup, licenses, pii, simhash, suffix_dedup, token_counts, toxicity
from .common import read

#: The vocabulary of the token operators; a parameter of theirs.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(read(spark, sf_dir, "documents"), token_counts.sample_edits(), VOCABULARY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), VOCABULARY)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup_digests(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digests(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "pipeline": pipeline,
}
