"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes sets the cuts, so that text shifted by an insertion is cut alike again
after it. Chunks are deduplicated by digest: of equal ones the first stays, in order of document id and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, whole_text


@dataclass(frozen=True)
class Chunking:
    """bits: a place is a cut with probability 2**-bits; least, most: bytes of a chunk; seed: of the gear table."""

    bits: int = 6
    least: int = 32
    most: int = 1024
    seed: int = 7

    def gear(self) -> np.ndarray:
        return np.random.RandomState(self.seed).randint(0, 1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


def cuts(raw: bytes, how: Chunking, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of ``raw``, the last being its length (none if it is empty)."""
    if not raw:
        return []
    h = gear[np.frombuffer(raw, dtype=np.uint8)]
    span = 1
    while span < 32:  # h(i) = sum of gear(byte(i - k)) << k for k < 32, by doubling
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    marks = np.flatnonzero(h < np.uint32(1 << (32 - how.bits))) + 1
    out, last = [], 0
    for mark in marks.tolist():
        while mark - last > how.most:
            last += how.most
            out.append(last)
        if mark - last >= how.least:
            out.append(mark)
            last = mark
    while len(raw) - last > how.most:
        last += how.most
        out.append(last)
    if last < len(raw):
        out.append(len(raw))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: rows of equal id and text share a key, 128 bits that stand for both."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text"))
    return rows.withColumn("key", F.unhex(F.md5(named.cast("binary"))))


def chunks(keyed: DataFrame, how: Chunking) -> DataFrame:
    """key, doc_id, start, digest (128 bits): every chunk of every text."""
    gear = how.gear()

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for doc_id, text, key in rows:
            raw = text.encode()
            start = 0
            for end in cuts(raw, how, gear):
                yield key, doc_id, start, xxhash.xxh3_128_digest(raw[start:end])
                start = end

    return map_texts(keyed.select("doc_id", "text", "key"), run, "key binary, doc_id long, start int, digest binary")


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking()) -> DataFrame:
    """Return doc_id, n_bytes, n_chunks, n_shared, n_removed, kept (binary): one row per row of ``docs``.

    n_shared: bytes in chunks that occur more than once in the corpus. A chunk stays in the document of smallest id
    that has it, at its first place there; elsewhere its bytes go (n_removed), and kept is what is left. Rows of equal
    id and text are one document and get equal results; a null id is larger than any other. Null and empty texts have
    no chunks. Texts of any length are cut whole. Empty table: empty result. Other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    rank = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    every = chunks(keyed.dropDuplicates(["key"]) if _repeats(keyed) else keyed, how)
    shared = every.groupBy("digest").agg(F.min(rank).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    of_doc = every.join(shared, "digest").select("key", F.struct("start", (rank == F.col("owner")).alias("own")).alias("chunk"))
    marked = of_doc.groupBy("key").agg(F.collect_list("chunk").alias("marks"))
    rows = keyed.join(marked, "key", "left").select("doc_id", "text", F.col("marks.start").alias("starts"), F.col("marks.own").alias("own"))
    gear = how.gear()

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for doc_id, text, starts, own in rows:
            raw = text.encode()
            ends = cuts(raw, how, gear)
            owned = dict(zip(starts or (), own or ()))
            shared_bytes, kept, start, first = 0, [], 0, set()
            for end in ends:
                piece = raw[start:end]
                if start in owned:
                    shared_bytes += end - start
                    if owned[start] and piece not in first:
                        first.add(piece)
                        kept.append(piece)
                else:
                    kept.append(piece)
                start = end
            left = b"".join(kept)
            yield doc_id, len(raw), len(ends), shared_bytes, len(raw) - len(left), left

    return map_texts(rows, run, "doc_id long, n_bytes long, n_chunks long, n_shared long, n_removed long, kept binary")


def _repeats(keyed: DataFrame) -> bool:
    """Whether some row is repeated with its id and text; only then is a row per key picked before chunking."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bool(counts.take(1))


def chunk_dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking()) -> DataFrame:
    """``chunk_dedup`` with kept as kept_sha256 (lowercase hex)."""
    out = chunk_dedup(docs, id_col, text_col, how)
    return out.select("doc_id", "n_bytes", "n_chunks", "n_shared", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
