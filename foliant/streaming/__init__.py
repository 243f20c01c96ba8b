"""Structured Streaming forms of the page and archive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import annotated_pages, page_texts
from ..sources.epub import book_tables
from ..sources.guards import Limits


def stream_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_batch: int = 64) -> DataFrame:
    """Pages as they arrive as Parquet files below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_texts(pages: DataFrame) -> DataFrame:
    """Text and title of a stream of pages: one pass, no state."""
    return page_texts(pages)


def stream_annotations(pages: DataFrame) -> DataFrame:
    return annotated_pages(pages)


def stream_archives(spark: SparkSession, path: str, limits: Limits = Limits(), files_per_batch: int = 16) -> dict[str, DataFrame]:
    """The tables of archives as they arrive below a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return book_tables(files.where(F.col("length") <= limits.max_bytes), limits, once=False)
