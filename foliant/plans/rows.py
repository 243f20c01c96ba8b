"""Running Python kernels over Arrow batches."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at a time.
SLICE_ROWS = 64
#: Markup nests as deep as it likes; kernels that recurse over it need room.
_DEPTH = 100_000
#: Rows to a task of tables whose rows are few bytes and much work, and the most tasks that such a table is dealt out to.
TASK_ROWS = 4_000
MOST_TASKS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out by its number of rows. A scan cuts tables by bytes, which leaves one task to a small file
    however much is made of each of its rows. Rows are counted first (for Parquet, from the footers)."""
    tasks = min(math.ceil(df.count() / TASK_ROWS), MOST_TASKS)
    return df.repartition(tasks) if tasks > 1 else df


def map_rows(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """One pass without an exchange: ``kernel`` takes the columns of a row and gives rows of ``schema``."""
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEPTH))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns))
                out = [made for row in rows for made in kernel(*row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
