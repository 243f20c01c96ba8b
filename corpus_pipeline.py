"""Entry point of the five-stage corpus pipeline; its stages are in ``foliant.llm.pipeline``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import pipeline

STAGES = pipeline.STAGES

#: SQL expresses neither the classifier nor the hashed shingles; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``: one row of token results for each document left."""
    return pipeline.run(spark, sf_dir, STAGES)
