"""Helpers shared by the text-preparation operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_folder

#: Rows turned into Python objects at a time; bounds a worker's memory, not the work.
SLICE_ROWS = 256
#: Rows of an Arrow batch, at most: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000
#: Bytes after which an Arrow batch is closed, at most, so that a worker holds few very long texts at a time.
BATCH_BYTES = 16 << 20
#: Called when a task begins that keeps nothing: they free what others keep in the worker from task to task.
FORGET: list[Callable[[], None]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Parts of a table of a few numbers a row, at least, when it is written to be read again.
LEAST_PARTS = 32


def materialise(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    ``narrow``: rows of a few numbers, written in two parts a core, so that the files and the tasks which read them don't
    number as many as the shuffle's partitions. A task goes through its partitions one after another, so it holds no more.
    """
    shared_folder(df.sparkSession)
    if narrow:
        df = df.coalesce(max(LEAST_PARTS, 2 * df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` where they may be larger.

    A plan reads these settings when it runs, so they stay lowered.
    """
    rows, size = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def forget() -> None:
    for free in FORGET:
        free()


def whole_text(text_col: str) -> Column:
    """The text column, null counting as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def gathered(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose small batches are joined to some of at least ``rows`` rows."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(50_000)
        held: list[pa.RecordBatch] = []
        size = 0
        for made in run(batches):
            held.append(made)
            size += made.num_rows
            if size >= rows:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    return joined


def map_texts(
    df: DataFrame, function: Callable[[list[tuple]], Iterator[tuple]], schema: str, start: Callable[[], object] | None = None
) -> DataFrame:
    """Apply ``function`` to slices of rows (tuples in the order of the columns) and return its tuples.

    ``start`` runs once a task and its value is passed on as second argument.
    """
    small_batches(df.sparkSession)
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(50_000)  # a slice's objects have no cycles; looking for them often costs a seventh of the time
        state = start() if start else forget()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                out = list(function(rows, state) if start else function(rows))
                if out:
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keys: list[Column], kept: DataFrame) -> DataFrame:
    """For each row of ``kept``, whose columns are values of ``keys`` (null is a value), one row of ``docs``.

    Rows travel packed, so that their columns may have any names. The join and the removal of repeats share one
    exchange, and the keys are nearly unique, so no group is hot.
    """
    rows = docs.select(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("key"), F.struct("*").alias("row"))
    wanted = kept.select(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept.columns))).alias("key"))
    return rows.join(wanted, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
