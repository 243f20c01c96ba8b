"""Corpus preparation: toxic documents go, copies and near-copies are reduced to one, benchmark leaks go, tokens come out.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns whole rows of
``documents``; the last returns one row of token results for each document left. For all stages: null texts count as
empty; texts of any length are used whole; rows that tie or repeat are told apart by id; extra columns, whatever their
names, are kept as they are; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_dedup, simhash, toxicity
from .common import keep_rows, materialise, read, shared_folder
from .queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the toxicity classifier on the labelled documents and keep those that it scores below 0.5.

    Null and empty texts score alike; of repeated rows all go or all stay; a score of just 0.5 goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of equal texts (one row where it is repeated; null ids come last)."""
    rows = materialise(exact_dedup.digests(docs))
    kept = exact_dedup.merged_runs(rows).select("digest", "keep_id")
    return keep_rows(docs, [exact_dedup.digest("text"), F.col("doc_id").cast("long")], kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-copies: candidates by SimHash, confirmed by sets of
    five-word shingles with a Jaccard similarity of 0.8 (one row where it is repeated; null ids come last)."""
    return simhash.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs; empty ones, and repeated rows, stay."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every document left; a row for each, empty ones and repeated ones too."""
    return bpe.bpe_digests(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("byte_level_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """Apply the stages to ``documents``; what each one keeps is written to the shared folder and read again.

    A stage's rows are deleted once the next one has written its own; the last one's input stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(stages):
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
