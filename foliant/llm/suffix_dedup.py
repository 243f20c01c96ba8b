"""Substring deduplication at byte level: repeated strings of ``length`` bytes, by two rounds of ranks over gathered positions.

Suffix sorting by prefix doubling ranks every position by pairs of ranks at growing offsets and drops a position once
its rank is unique. This module keeps the dropping of unique ranks and the sort of pairs of ranks at two offsets, but
not the doubling of offsets over all positions. Positions are first gathered instead: the windows of ``length`` bytes that have the same anchor
(the q-gram of smallest hash in the window) form a run, about one for every ``length`` / 4 bytes. A run's rank is that
of ``half`` bytes at its anchor, which all of its windows hold; its span's rank is that of all bytes of its windows.
Runs of unique rank are dropped, runs of equal span are repeated whole. Only windows of runs with equal rank and
different spans are looked at one by one: Spark sorts their pairs of ranks (of ``half`` bytes at the start and at the
offset that completes the window) with their run's rank, and equal neighbours are repeated. Ranks are 64-bit hashes that
any task computes from the text alone, so no round has to move ranks of all positions. Runs and windows are equal only if
both of their ranks are; among those of one run, which hold the same ``half`` bytes, the second decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_texts, materialise, small_batches, whole_text

_BASE = 0x9E3779B97F4A7C15
#: Window starts worked on at a time; longer texts go in pieces.
_PIECE = 1 << 18
#: Slots of the fixed-size bitmap (1 MB) that keeps most texts out of the joins.
_SLOTS = 1 << 23
#: Spans of one rank in a part of the windows' sort; ranks of more are sorted in parts first, then one window of each part.
_PART_SPANS = 20_000


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64)))


class _Hasher:
    """64-bit hashes of substrings of one text, from prefix sums."""

    size = 0

    def __init__(self, raw: bytes):
        n = len(raw)
        if _Hasher.size <= n:
            _Hasher.size = max(_PIECE + 2048, n + 1)
            _Hasher.up, _Hasher.down = _powers(_BASE, _Hasher.size), _powers(pow(_BASE, -1, 1 << 64), _Hasher.size)
            _Hasher.table = np.random.RandomState(5).randint(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[np.frombuffer(raw, dtype=np.uint8)] * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Repeats:
    """length: of the strings in bytes; gram: bytes of an anchor."""

    length: int = 400
    gram: int = 16

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length or self.length - self.gram + 1 > 1023:
            raise ValueError("a run must hold fewer than 1,024 windows, and a gram must fit into one")

    @property
    def half(self) -> int:
        """Bytes at an anchor, on one side or the other, that every window around it holds."""
        return (self.length + self.gram) // 2

    def runs(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rank, span, first window start, windows) of the runs of one piece of text."""
        n, t, q = len(raw), self.length, self.gram
        hashed = _Hasher(raw)
        at = np.arange(n - q + 1)
        least = (hashed.of(at, at + q) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        wide, step = t - q + 1, 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        count = n - t + 1
        anchor = (np.minimum(least[:count], least[wide - step : wide - step + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], count) - 1
        place = anchor[first]
        # A window holds ``half`` bytes that end with the anchor, or else ``half`` bytes that begin with it.
        before = self.half - q
        left_last, right_first = np.minimum(last, place - before), np.maximum(first, place - before + 1)
        left, right = left_last >= first, right_first <= last
        lo, hi = np.concatenate([first[left], right_first[right]]), np.concatenate([left_last[left], last[right]])
        begin = np.concatenate([place[left] - before, place[right]])
        side = np.concatenate([np.zeros(left.sum(), np.uint64), np.ones(right.sum(), np.uint64)])
        with np.errstate(over="ignore"):
            rank = _mixed(hashed.of(begin, begin + self.half) + side)
            span = _mixed(hashed.of(lo, hi + t) + (begin - lo).astype(np.uint64) * np.uint64(_BASE))
        return rank, span, lo, hi - lo + 1

    def windows(self, raw: bytes, start: int, count: int) -> np.ndarray:
        """Ranks of ``count`` windows from ``start`` on: each from the pair of its two halves' ranks."""
        hashed = _Hasher(raw[start : start + count + self.length - 1])
        at = np.arange(count)
        shift = self.length - self.half
        with np.errstate(over="ignore"):
            return _mixed(hashed.of(at, at + self.half) * np.uint64(_BASE) + hashed.of(at + shift, at + self.length))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: 128 bits that stand for a row's id and whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text"))
    return rows.withColumn("key", F.unhex(F.md5(named.cast("binary"))))


def _records(keyed: DataFrame, how: Repeats) -> DataFrame:
    """rank, span, key, at (first window start * 1024 + windows): every run of every text."""
    small_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, key in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for piece in range(0, len(raw) - how.length + 1, _PIECE):
                    rank, span, lo, n = how.runs(raw[piece : piece + _PIECE + how.length - 1])
                    columns = [rank.view(np.int64), span.view(np.int64), pa.repeat(key, len(rank)), (lo + piece) * 1024 + n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rank", "span", "key", "at"])

    return keyed.select("text", "key").mapInArrow(gathered(run), "rank long, span long, key binary, at long")


def _flagged(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` with a flag that is true for every row whose key is in ``keys``, and false for most others.

    The keys become a bitmap of fixed size, so what is broadcast doesn't grow with the data.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(_SLOTS)) + 1
    bits = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    bits = materialise(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = keyed.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket", "left")
    return joined.withColumn("flag", F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bits")


def _neighbours(parts: bool):
    """Arrow function over rows (rank, run, ref) sorted by rank and run: refs of rows that have an equal one, but for those
    whose low bit, 'known', is set. With ``parts`` also one row of each group that is to be compared with other parts',
    known if its group has been told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the last row, whose group may go on
        tied, opened = False, True  # whether it equals the one before; whether its group has no representative yet

        def told(rows: np.ndarray, hit: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            rank, run_, ref = (c[hit & (rows[2] & 1 == 0)] for c in rows)
            again = np.zeros(len(ref), bool)
            if parts:
                rank, run_ = np.concatenate([rank, rows[0][first]]), np.concatenate([run_, rows[1][first]])
                ref, again = np.concatenate([ref, rows[2][first] | hit[first]]), np.concatenate([again, np.ones(first.sum(), bool)])
            return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(run_), pa.array(ref), pa.array(again)], ["rank", "run", "ref", "again"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            same = (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)
            hit = np.append(tied if held.shape[1] else False, same)[:-1] | same
            first = np.append(opened if held.shape[1] else True, ~same)
            yield told(rows[:, :-1], hit, first[:-1])
            tied, opened = bool(same[-1]) if len(same) else tied, bool(first[-1])
            held = rows[:, -1:]
        if held.shape[1]:
            yield told(held, np.array([tied]), np.array([opened]))

    return run


def _repeated(pairs: DataFrame, hot: bool) -> DataFrame:
    """ref: the windows (rank, run, ref, part) that occur more than once, but for known ones."""
    schema = "rank long, run long, ref long, again boolean"

    def sort(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by).select("rank", "run", "ref")

    if not hot:
        return sort(pairs, "rank", "run").mapInArrow(_neighbours(False), schema).select("ref")
    # Ranks of very many spans are sorted in parts, so that no task gets all windows that hold a frequent passage.
    single = sort(pairs.where("part < 0"), "rank", "run").mapInArrow(_neighbours(False), schema).select("ref")
    of_parts = materialise(sort(pairs.where("part >= 0"), "part", "rank", "run").mapInArrow(_neighbours(True), schema))
    met = sort(of_parts.where("again"), "rank", "run").mapInArrow(_neighbours(False), schema).select("ref")
    return single.union(of_parts.where("not again").select("ref")).union(met)


def repeated_windows(keyed: DataFrame, how: Repeats = Repeats(), part_spans: int = _PART_SPANS) -> DataFrame:
    """key, at (first start * 1024 + windows): windows of ``how.length`` bytes that also start elsewhere."""
    records = _records(keyed, how)
    groups = records.groupBy("rank", "span").agg(F.min(F.struct("key", "at")).alias("one"), F.count(F.lit(1)).alias("copies"))
    ranks = groups.groupBy("rank").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1")
    told = groups.join(ranks, "rank", "left").where("copies > 1 or spans > 1")
    told = materialise(told.select("rank", "span", "one", "copies", "spans", F.monotonically_increasing_id().alias("id")))
    whole = records.join(told.where("copies > 1").select("rank", "span"), ["rank", "span"], "left_semi").select("key", "at")

    part = F.when(F.col("spans") > part_spans, F.pmod(F.xxhash64("id"), F.ceil(F.col("spans") / part_spans))).otherwise(-1).cast("int").alias("part")
    known = (F.col("copies") > 1).cast("int").alias("known")
    asked = told.where("spans > 1").select("id", F.col("rank").alias("run"), F.col("one.key").alias("key"), F.col("one.at").alias("at"), known, part)
    hot = bool(asked.where("part >= 0").take(1))
    of_key = asked.groupBy("key").agg(F.collect_list(F.struct("id", "run", "at", "known", "part")).alias("asked"))
    texts = _flagged(keyed, asked.select("key")).where("flag").dropDuplicates(["key"]).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spans in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for s in spans.as_py():
                    start, n = divmod(s["at"], 1024)
                    ref = (s["id"] * 1024 + np.arange(n)) * 2 + s["known"]
                    columns = [how.windows(raw, start, n).view(np.int64), np.full(n, s["run"]), ref, np.full(n, s["part"], np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rank", "run", "ref", "part"])

    pairs = texts.join(of_key, "key").select("text", "asked").mapInArrow(gathered(run), "rank long, run long, ref long, part int")
    hits = _repeated(pairs, hot).select(F.shiftright("ref", 11).alias("id"), (F.shiftright("ref", 1) % 1024).alias("offset"))
    single = hits.join(asked.select("id", "key", "at"), "id").select("key", ((F.shiftright("at", 10) + F.col("offset")) * 1024 + 1).alias("at"))
    return whole.union(single)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """Return doc_id, n_bytes, spans (array of removed (start, end) in bytes), kept (binary): one row per row of ``docs``.

    A byte goes if a string of ``how.length`` bytes that covers it starts anywhere else too, in the same document or
    another; repeated rows (equal id and text) are documents of their own, so all of a long enough one goes. Null
    texts count as empty; texts shorter than the length stay whole; very long ones are worked on in pieces, whole.
    Empty table: empty result. Other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    windows = materialise(repeated_windows(keyed, how))
    of_key = windows.groupBy("key").agg(F.collect_list("at").alias("windows"))
    flagged = _flagged(keyed, windows.select("key"))
    none = F.expr("cast(null as array<bigint>)")
    rows = flagged.where("flag").join(of_key, "key", "left").select("doc_id", "text", "windows")
    rows = rows.union(flagged.where("not flag").select("doc_id", "text", none))

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for doc_id, text, found in rows:
            raw = text.encode()
            gone = np.zeros(len(raw) + 1, dtype=np.int64)
            if found:
                start, n = np.divmod(np.array(found, dtype=np.int64), 1024)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + n + how.length - 1, -1)
            covered = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
            yield doc_id, len(raw), spans, np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes() if spans else raw

    return map_texts(rows, run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def suffix_dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """Return doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ``suffix_dedup``."""
    out = suffix_dedup(docs, id_col, text_col, how)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
