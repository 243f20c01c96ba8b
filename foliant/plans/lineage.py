"""Cutting lineage: results written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder that is set, by call or as ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) gets a temporary folder where none is set; a cluster without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="foliant-")
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in a folder for each value of ``partitions``, and read again.

    Readers of some of its columns or partitions read only those. The files stay until the caller deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliant-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
