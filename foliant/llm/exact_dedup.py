"""Exact deduplication: digest runs merged in a tree.

Every input partition yields a run of (digest, smallest id, rows); runs meet in rounds, ``fan_in`` at a time, and
each merge keeps the smallest identifier and the row count of a digest, until one run is left. A merge is a
sort-based aggregate (its buffer holds a struct), partial before the exchange, so a digest with a third of all rows
crosses the network once per map task and round, never row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text

#: Every run of white space that isn't a single space already.
_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text_col: str):
    """The text with each run of ``[\\x20\\x09-\\x0D]`` made one space; null gives the empty text."""
    return F.regexp_replace(whole_text(text_col), _SPACES, " ")


def digest(text_col: str = "text"):
    """SHA-256 of the normalised text, binary."""
    return F.unhex(F.sha2(normalised(text_col), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest (SHA-256 of the normalised text, binary) and an independent check hash."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    return text.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"))


def merged_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """(digest, keep_id, group_size) from the rows of ``digests``; fails if equal digests have unequal checks."""

    def merge(df: DataFrame, first: bool) -> DataFrame:
        return df.groupBy("run", "digest").agg(
            F.min("best").alias("best"),
            (F.count(F.lit(1)) if first else F.sum("group_size")).alias("group_size"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )

    tagged = rows.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        "digest",
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("best"),
        F.col("check").alias("low"),
        F.col("check").alias("high"),
    )
    out, left = merge(tagged, True), runs
    while left > 1:
        left = -(-left // fan_in)
        out = merge(out.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), False)
    verified = F.when(F.col("low") == F.col("high"), F.col("best.id")).otherwise(
        F.raise_error(F.lit("equal digests of unequal texts")).cast("long")
    )
    return out.select("digest", verified.alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Null texts count as empty and form a group with the empty ones; texts of any length count whole. A null id is larger than any other, so it is
    kept only where its group has no other id. Repeated rows (same id, equal text) are one document: all of them
    carry ``kept``. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    rows = materialise(digests(docs, id_col, text_col))
    groups = merged_runs(rows, runs, fan_in).where("group_size > 1")
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
