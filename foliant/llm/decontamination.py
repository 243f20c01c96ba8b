"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, scanned over training windows.

Words of the benchmark get numbers; a document becomes a sequence of those numbers (0: in no item), windows get a
polynomial hash in numpy, and a window whose hash is in the set is verified word by word. The set is broadcast only
after its windows were counted. Above ``max_windows`` they stay on the executors: a bitmap of fixed size picks the
documents' windows that may occur in the benchmark, and an equi-join on the windows themselves verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, small_batches, whole_text

#: A-Z to a-z; every byte outside [0-9a-z\x80-\xFF] to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z."""
    return text.encode().translate(_FOLD).split()


class Windows:
    """The windows of some benchmark items: ``width`` consecutive words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(width, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                self.items.setdefault(tuple(words[at : at + size]), set()).add(item_id)
        self.hashes: dict[int, np.ndarray] = {}
        for size in sorted({len(w) for w in self.items}):
            rows = np.array([w for w in self.items if len(w) == size], dtype=np.uint64)
            self.hashes[size] = np.unique(_rolling(rows.T))

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """(number of words, mask of hit words, items with occurring windows)."""
        words = words_of(text)
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        hit = np.zeros(len(words), dtype=bool)
        found: set[str] = set()
        known = np.append(0, np.cumsum(ids != 0))
        for size, hashes in self.hashes.items():
            if len(words) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            keys = _rolling([ids[starts + k] for k in range(size)])
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for start in starts[hashes[at] == keys].tolist():
                if items := self.items.get(tuple(ids[start : start + size].tolist())):
                    hit[start : start + size] = True
                    found |= items
        return len(words), hit, found


def _rolling(columns) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            out = (out + column) * _MULTIPLIER
            out ^= out >> np.uint64(29)
    return out


#: Slots of the bitmap that picks documents' windows when the benchmark is large (8 MB); hashes beyond its slots share them.
_SLOTS = 1 << 26
_SLOT_BYTES = 4096  # of one row of the bitmap, as Spark's bitmap functions make them
#: A word before lower-casing; what these texts are split into, counted without Python.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), whole_text(text_col).alias("text"))


def _small(items: DataFrame, width: int, max_windows: int) -> Windows | None:
    """The benchmark's windows on the driver, if they are few enough; a window takes some 500 bytes."""
    words = F.regexp_count("text", F.lit(_RAW_WORD))
    windows = F.when(words == 0, 0).otherwise(F.greatest(words - width + 1, F.lit(1)))
    total, size = items.agg(F.sum(windows.cast("long")), F.sum(F.octet_length("text").cast("long"))).first()
    if (total or 0) > max_windows or (size or 0) > 50 * max_windows:
        return None
    return Windows([tuple(r) for r in items.collect()], width)


def _key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for a row's id and whole text."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), whole_text(text_col))
    return F.unhex(F.md5(named.cast("binary")))


def _slot(window: bytes) -> int:
    return xxhash.xxh3_64_intdigest(window) % _SLOTS


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """key, spans (first word, words), items: rows of ``docs`` with windows of a benchmark of any size."""

    def windows_of(words: list[bytes], size: int) -> Iterator[tuple[int, bytes]]:
        return ((at, b" ".join(words[at : at + size])) for at in range(len(words) - size + 1))

    def of_item(rows: list[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            words = words_of(text)
            size = min(width, len(words))
            for _, window in windows_of(words, size) if size else ():
                yield item, size, window, _slot(window)

    windows = materialise(map_texts(items, of_item, "item string, size int, window binary, slot long").distinct())
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``width``
    slot = F.col("slot") + 1
    bits = windows.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    picked = np.zeros(_SLOTS // 8, dtype=np.uint8)
    for bucket, part in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect():
        picked[(bucket - 1) * _SLOT_BYTES : bucket * _SLOT_BYTES] = np.frombuffer(bytes(part), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(picked)

    def of_doc(rows: list[tuple], bitmap: np.ndarray) -> Iterator[tuple]:
        for key, text in rows:
            words = words_of(text)
            for size in sizes:
                for at, window in windows_of(words, size):
                    place = _slot(window)
                    if bitmap[place >> 3] >> (place & 7) & 1:
                        yield key, at, size, window

    texts = docs.select(_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text"))
    asked = map_texts(texts, of_doc, "key binary, at int, size int, window binary", lambda: shared.value)
    met = asked.join(windows.select("item", "size", "window"), ["size", "window"])
    return met.groupBy("key").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set("item").alias("items"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    max_windows: int = 200_000,
) -> DataFrame:
    """Return doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    Null and empty texts have no words and are clean; so are all documents if the benchmark is empty. Items without
    words have no windows; null item ids count as the string 'null'; equal items are listed each. Texts of any length
    are scanned whole; repeated rows repeat. Other columns are not read. Empty table: empty result.
    """

    def row(n: int, hit: int, found: set[str]) -> tuple:
        return n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0

    items = _items(benchmark, item_col, item_text_col)
    windows = _small(items, width, max_windows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    if windows is None:
        found = _found(docs, items, id_col, text_col, width)
        rows = texts.select("doc_id", F.regexp_count("text", F.lit(_RAW_WORD)).cast("long").alias("n_words"), _key("doc_id", "text").alias("key"))
        words = F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))
        n_hit = F.coalesce(F.size(F.array_distinct(words)), F.lit(0)).cast("long")
        n_hit = F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n_hit)
        joined = F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ",")
        return rows.join(found, "key", "left").select(
            "doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(joined, 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            n, hit, found = shared.value.scan(text)
            yield doc_id, *row(n, int(hit.sum()), found)

    return map_texts(texts, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    mode: str = "document",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    max_windows: int = 200_000,
) -> DataFrame:
    """The rows of ``docs`` without those that hold a benchmark window (``mode='document'``), or with the hit words and
    what stands between them cut out of their texts (``mode='span'``); all columns of ``docs``, of any names, stay.

    Null and empty texts hold none and stay as they are; repeated rows are treated alike; texts of any length are scanned
    whole; an empty benchmark changes nothing; an empty table gives an empty one.
    """
    items = _items(benchmark, item_col, item_text_col)
    windows = _small(items, width, max_windows)
    small_batches(docs.sparkSession)
    own = F.col(f"`{text_col}`").cast("string")
    if windows is not None:
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        if mode == "span":
            cut = F.udf(lambda text: text if text is None else _cut(text, shared.value.scan(text)[1]), "string", useArrow=True)
            return docs.withColumn(text_col, cut(own))
        clean = F.udf(lambda text: not shared.value.scan(text or "")[1].any(), "boolean", useArrow=True)
        return docs.where(clean(own))
    texts = docs.select(F.lit(None).cast("long").alias("id"), own.alias("text"))
    found = _found(texts.distinct(), items, "id", "text", width).select(F.col("key").alias("found"), "spans")
    rows = docs.select(F.struct("*").alias("row"), own.alias("text")).withColumn("key", _key_of_text())
    if mode != "span":
        return rows.join(found, F.col("key") == F.col("found"), "left_anti").select("row.*")

    def without(text: str | None, spans: list | None) -> str | None:
        if text is None or not spans:
            return text
        hit = np.zeros(len(words_of(text)), dtype=bool)
        for at, size in spans:
            hit[at : at + size] = True
        return _cut(text, hit)

    cut = F.udf(without, "string", useArrow=False)
    joined = rows.join(found, F.col("key") == F.col("found"), "left")
    return joined.select(F.col("row").withField(f"`{text_col}`", cut("text", "spans")).alias("row")).select("row.*")


def _key_of_text() -> Column:
    return F.unhex(F.md5(F.concat(F.lit("null:"), F.coalesce("text", F.lit(""))).cast("binary")))


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; a run of hit words goes with all that stands between them."""
    if not hit.any():
        return text
    raw = text.encode()
    folded = raw.translate(_FOLD)
    marks = np.frombuffer(folded, dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    out, at, i = [], 0, 0
    while i < len(hit):
        if hit[i]:
            j = i
            while j + 1 < len(hit) and hit[j + 1]:
                j += 1
            out.append(raw[at : begins[i]])
            at, i = int(ends[j]), j
        i += 1
    out.append(raw[at:])
    return b"".join(out).decode()
