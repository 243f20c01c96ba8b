"""Near-duplicate detection: 64-bit SimHash fingerprints linked by a bit-sliced comparison.

Fingerprints within ``radius`` bits of each other agree on at least ``blocks - radius`` of ``blocks`` bit fields, so
every choice of that many fields gives a bucket key and no link is lost. Buckets are cut into chunks of bounded
size; each pair of chunks is one unit of work, so a bucket of any size spreads over tasks. Units are compared with
bit planes stored vertically (one bit of many fingerprints in a machine word), distances counted by carry-save
bitwise counters, and rows dropped as soon as all their counters have passed the radius. A unit yields a spanning
forest of its links, not all pairs.

``near_copies`` is the same comparison for a looser similarity, that of sets of five-word shingles: fingerprints of 128
bits, buckets by samples of their bits, a wider radius, and every link confirmed on the texts' own shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_texts, materialise, whole_text
from .components import connected_components

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles of ``text``: A-Z lower-cased, words split at ``[\\x20\\x09-\\x0D]``.

    Fewer words than ``width``: the whole sequence is the only shingle; none: 0. Repeats count.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            fp = fingerprint(text, width)
            yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), run, "doc_id long, fp long")


def near_pairs(values: np.ndarray, radius: int, step: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """For each row i the rows j < i within ``radius`` bits, by vertical planes and carry-save counters.

    ``values``: a fingerprint a row, in one 64-bit word or several.
    """
    n = len(values)
    values = values.reshape(n, -1)
    words, size = -(-n // 64), 64 * values.shape[1]
    padded = np.zeros((words * 64, values.shape[1]), dtype=np.uint64)
    padded[:n] = values
    planes = np.empty((size, words), dtype=np.uint64)
    for bit in range(size):
        column = ((padded[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.uint8)
        planes[bit] = np.packbits(column, bitorder="little").view("<u8")
    counters = max(1, int(radius).bit_length())
    start = (1 << counters) - 1 - radius  # so that the top carry means radius + 1
    rows = np.arange(n)
    count = [np.full((n, words), _ONES if start >> k & 1 else 0, dtype=np.uint64) for k in range(counters)]
    # Lanes of later rows, of the row itself and of the padding start as exceeded.
    lane = np.arange(words * 64)
    over = np.packbits(lane[None, :] >= rows[:, None], axis=1, bitorder="little").view("<u8").reshape(n, words).copy()
    for bit in range(size):
        mask = np.where((values[rows, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1), _ONES, np.uint64(0))
        carry = planes[bit][None, :] ^ mask[:, None]
        for k in range(counters):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if bit % step == step - 1:
            alive = (over != _ONES).any(axis=1)
            if not alive.any():
                return
            if not alive.all():
                rows, over = rows[alive], over[alive]
                count = [c[alive] for c in count]
    for i, gone in zip(rows, over):
        yield int(i), np.flatnonzero(np.unpackbits(gone.view(np.uint8), bitorder="little") == 0)


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) of a spanning forest of the graph whose links are the pairs within ``radius``."""
    label = np.arange(len(values))
    for i, near in near_pairs(values, radius):
        roots = np.unique(label[np.append(near, i)])
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]
    return [(i, int(r)) for i, r in enumerate(label) if r != i]


def _units(links: Callable[[list[list[np.ndarray]]], pa.RecordBatch], unit_rows: int):
    """Arrow function over rows sorted by their first column, the unit: whole units are gathered up to ``unit_rows``
    and handed over together, column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        whole: list[list[np.ndarray]] = []  # of units that are complete
        rest: list[list[np.ndarray]] = []  # of the unit that may go on
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(unit))):
                if unit[a] != last and rest:
                    whole += rest
                    held += sum(len(part[0]) for part in rest)
                    rest = []
                    if held >= unit_rows:
                        yield links(whole)
                        whole, held = [], 0
                last = unit[a]
                rest.append([c[a:b] for c in columns])
        if whole or rest:
            yield links(whole + rest)

    return run


def _compare(radius: int, unit_rows: int):
    """Links between the fingerprints, which are their own ids, of units compared together."""

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        values = np.unique(np.concatenate([p[0] for p in parts])).view(np.uint64)
        found = forest(values, radius)
        signed = values.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([int(signed[a]) for a, _ in found], pa.int64()), pa.array([int(signed[b]) for _, b in found], pa.int64())], ["u", "v"]
        )

    return _units(links, unit_rows)


def _dealt(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """``rows`` (bucket, id, more) of buckets that hold more than one, a row for each unit: a pair of the bucket's chunks."""
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk_rows).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("chunk")), chunks).cast("int")
    placed = rows.join(crowded, "bucket").withColumns({"chunks": chunks, "own": own}).drop("n")
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    return paired.select(unit, *[c for c in rows.columns if c != "bucket"]).repartition("unit").sortWithinPartitions("unit")


def near_links(fps: DataFrame, radius: int = 3, blocks: int = 5, chunk_rows: int = 512) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all pairs within ``radius`` bits.

    No bucket is capped: one of n fingerprints is cut into about n / ``chunk_rows`` chunks and every pair of its
    chunks is compared in a unit of its own.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    fields = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(i), *(fields[k] for k in chosen)) for i, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    rows = fps.select(F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("id"))
    return _dealt(rows, chunk_rows).mapInArrow(_compare(radius, chunk_rows), "u long, v long")


def near_groups(rows: DataFrame, radius: int = 3, blocks: int = 5, chunk_rows: int = 512) -> DataFrame:
    """(fp, root, component_id) for the fingerprints of ``rows`` (doc_id, fp): the component's smallest fingerprint and id."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(near_links(classes, radius, blocks, chunk_rows))
    member = nodes.select(F.col("node").alias("fp"), "root").join(classes, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(least, "root").select("fp", "root", "component_id")
    alone = classes.join(nodes.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return linked.union(alone)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 5, chunk_rows: int = 512
) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable): one row per row of ``docs``.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other; texts of any length
    count whole. Repeated rows
    and texts share a fingerprint and so a component. Null ids get a component but never name one unless all its ids
    are null. An empty table gives an empty result; other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col))
    groups = near_groups(rows, radius, blocks, chunk_rows)
    return rows.join(groups, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearCopies:
    """Texts are linked whose sets of ``width``-word shingles have a Jaccard similarity of at least up / down.

    gram: words of the fingerprints' shingles (fewer than ``width``, so that an edit changes fewer of them); radius: bits
    of 128 in which linked texts may differ; distance: bits for which ``miss`` is the chance that no bucket is shared;
    bucket_rows: mean rows of a bucket; class_bytes, class_rows: what one task compares of a class of candidates.
    """

    width: int = 5
    up: int = 4
    down: int = 5
    gram: int = 3
    radius: int = 26
    distance: int = 18
    miss: float = 0.005
    bucket_rows: int = 64
    class_bytes: int = 8 << 20
    class_rows: int = 2048

    def masks(self, rows: int) -> list[tuple[int, int]]:
        """Samples of the 128 bits, as two signed words each; more of them, of more bits, the more rows there are."""
        bits = min(40, max(8, ceil(log2(max(rows, 2) / self.bucket_rows))))
        met = comb(128 - self.distance, bits) / comb(128, bits)
        rnd = np.random.RandomState(11)
        out = []
        for _ in range(ceil(log(self.miss) / log(1 - met))):
            chosen = np.zeros(128, dtype=np.uint8)
            chosen[rnd.choice(128, bits, replace=False)] = 1
            out.append(tuple(np.packbits(chosen, bitorder="little").view("<i8").tolist()))
        return out

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two ascending arrays of distinct shingle hashes are similar."""
        if self.down * min(len(a), len(b)) < self.up * max(len(a), len(b)):
            return False
        same = len(np.intersect1d(a, b, assume_unique=True))
        return self.down * same >= self.up * (len(a) + len(b) - same)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct hashes (XXH64, ascending) of the ``width``-word shingles; fewer words: the whole sequence."""
    words = text.encode().lower().split()
    found = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), dtype="<u8"))


def wide_fingerprint(text: str, gram: int) -> bytes:
    """The 128-bit SimHash, little-endian, of the set of ``gram``-word shingles."""
    words = text.encode().lower().split()
    found = map(b" ".join, zip(*(words[i:] for i in range(gram)))) if len(words) >= gram else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, set(found))), dtype=np.uint8).reshape(-1, 16)
    ones = np.zeros(128, dtype=np.int64)
    for at in range(0, len(digests), 8192):
        ones += np.unpackbits(digests[at : at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests), bitorder="little").tobytes()


def text_key(text_col: str = "text") -> Column:
    """128 bits that stand for the whole text."""
    return F.unhex(F.md5(whole_text(text_col).cast("binary")))


def _points(docs: DataFrame, id_col: str, text_col: str, how: NearCopies) -> DataFrame:
    """id, key, a, b, n, least (none, doc_id): each distinct text, its fingerprint's words, its rows and their least id."""

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for doc_id, key, text in rows:
            yield doc_id, key, *np.frombuffer(wide_fingerprint(text, how.gram), dtype="<i8").tolist()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), whole_text(text_col).alias("text"))
    rows = map_texts(texts, run, "doc_id long, key binary, a long, b long")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    once = rows.groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.count(F.lit(1)).alias("n"), least)
    return materialise(once.select(F.monotonically_increasing_id().alias("id"), "key", "a", "b", "n", "least"))


def _candidates(points: DataFrame, how: NearCopies, chunk_rows: int = 512) -> DataFrame:
    """Links (u, v: ids) that connect all fingerprints within the radius that meet in a bucket."""
    keys = [F.xxhash64(F.lit(i), F.col("a").bitwiseAND(F.lit(a)), F.col("b").bitwiseAND(F.lit(b))) for i, (a, b) in enumerate(how.masks(points.count()))]
    rows = points.select(F.explode(F.array(*keys)).alias("bucket"), "id", "a", "b")

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        words = np.stack([np.concatenate([p[k] for p in parts])[first] for k in (1, 2)], axis=1).view(np.uint64)
        found = np.array(forest(words, how.radius), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[found[:, k]], pa.int64()) for k in (0, 1)], ["u", "v"])

    return _dealt(rows, chunk_rows).mapInArrow(_units(links, chunk_rows), "u long, v long")


def _members(docs: DataFrame, points: DataFrame, classes: DataFrame, text_col: str, how: NearCopies) -> DataFrame:
    """class, id, a, b, shingles (binary): the texts that have candidates."""
    asked = materialise(points.join(classes.select(F.col("node").alias("id"), F.col("root").alias("class")), "id"), narrow=True)
    if asked.count() <= 500_000:  # some 60 bytes each; beyond, a join by key with Spark's own Bloom filter
        asked = F.broadcast(asked)
    texts = docs.select(text_key(text_col).alias("key"), whole_text(text_col).alias("text")).join(asked, "key").dropDuplicates(["id"])

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for group, key, a, b, text in rows:
            yield group, key, a, b, shingle_set(text, how.width).tobytes()

    return materialise(map_texts(texts.select("class", "id", "a", "b", "text"), run, "class long, id long, a long, b long, shingles binary"))


def _centres(members: DataFrame, by_class: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """class, id, shingles: of each class the member nearest to the majority of its fingerprints' bits."""
    words = [(w, i) for w in ("a", "b") for i in range(64)]
    ones = [(2 * F.sum(F.shiftrightunsigned(w, i).bitwiseAND(F.lit(1))) > F.count(F.lit(1))).alias(f"{w}{i}") for w, i in words]
    votes = members.groupBy("class").agg(*ones)
    bits = {w: reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.col(f"{w}{i}"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64))) for w in ("a", "b")}
    centre = votes.select("class", bits["a"].alias("ca"), bits["b"].alias("cb"))
    away = F.bit_count(F.col("a").bitwiseXOR(F.col("ca"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("cb")))
    nearest = members.select("class", "id", "a", "b").join(by_class(centre), "class").groupBy("class").agg(F.min(F.struct(away.alias("away"), "id")).alias("least"))
    return members.join(by_class(nearest.select("class", F.col("least.id").alias("id"))), ["class", "id"]).select("class", "id", "shingles")


def _confirmed(members: DataFrame, how: NearCopies) -> DataFrame:
    """Links (u, v) that connect all pairs of a class within the radius whose shingles are similar.

    A class that one task can hold is compared there. Of a larger one, all members are held against its central one
    first; only those that it doesn't link are cut into chunks and compared with each other and with all the rest.
    """
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("shingles")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("rows") / how.class_rows), F.ceil(F.col("bytes") / how.class_bytes)).cast("int")
    size = materialise(size.select("class", parts.alias("parts")).where("parts > 1"), narrow=True)
    n_large = size.count()
    if not n_large:
        return _in_units(members.select(F.xxhash64("class").alias("unit"), "id", F.col("id").alias("label"), "a", "b", "shingles"), how)

    def by_class(df: DataFrame) -> DataFrame:
        """A few numbers for each large class: sent to all tasks while they are few, so that no large class meets in one."""
        return F.broadcast(df) if n_large <= 200_000 else df

    sized = members.join(by_class(size), "class", "left")
    large = sized.where("parts is not null")

    def star(rows: list[tuple]) -> Iterator[tuple]:
        for group, key, centre, own, other in rows:
            if key != centre and how.alike(np.frombuffer(own, "<u8"), np.frombuffer(other, "<u8")):
                yield group, key, centre

    centres = materialise(_centres(large, by_class))  # a row for each large class; the class's members are spread over its salts
    dealt = centres.join(size, "class").select(
        "class", F.col("id").alias("centre"), F.col("shingles").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    )
    salted = large.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("parts")).cast("int"))
    linked = materialise(
        map_texts(salted.join(dealt, ["class", "salt"]).select("class", "id", "centre", "shingles", "other"), star, "class long, id long, centre long")
    )

    known = large.join(linked.select("class", "id", "centre"), ["class", "id"], "left").join(by_class(centres.select("class", F.col("id").alias("own"))), "class")
    free = F.col("centre").isNull() & (F.col("id") != F.col("own"))
    known = known.withColumns({"label": F.when(free, F.col("id")).otherwise(F.col("own")), "free": free})
    left = known.where("free").groupBy("class").agg(F.count(F.lit(1)).alias("n_free"), F.sum(F.length("shingles")).alias("free_bytes"))
    loose = F.greatest(F.ceil(F.col("n_free") / how.class_rows), F.ceil(F.col("free_bytes") / how.class_bytes)).cast("int")
    known = known.join(by_class(left.select("class", loose.alias("loose"))), "class")  # classes whose centre links all are done
    own = F.pmod(F.xxhash64("id", F.lit("chunk")), F.when(F.col("free"), F.col("loose")).otherwise(F.col("parts"))).cast("int")
    # Chunks of free members meet each other and every chunk of linked ones, whose numbers are below 0.
    known = known.withColumn("chunk", F.when(F.col("free"), own).otherwise(-own - 1))
    free_chunks, tied_chunks = F.sequence(F.lit(0), F.col("loose") - 1), F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: -i)
    met = known.withColumn("other", F.explode(F.when(F.col("free"), F.concat(free_chunks, tied_chunks)).otherwise(free_chunks)))
    unit = F.xxhash64("class", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = met.select(unit.alias("unit"), "id", "label", "a", "b", "shingles")
    rows = rows.union(sized.where("parts is null").select(F.xxhash64("class").alias("unit"), "id", F.col("id").alias("label"), "a", "b", "shingles"))
    return linked.select(F.col("id").alias("u"), F.col("centre").alias("v")).union(_in_units(rows, how))


def _in_units(rows: DataFrame, how: NearCopies) -> DataFrame:
    """Links that connect the similar pairs of each unit (unit, id, label, a, b, shingles); equal labels are linked already."""

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, label, a, b, sets = (np.concatenate([p[k] for p in parts]) for k in range(5))
        sets = [np.frombuffer(x, "<u8") for x in sets]
        out: list[tuple[int, int]] = []
        for i, near in near_pairs(np.stack([a, b], axis=1).view(np.uint64), how.radius):
            for j in near.tolist():
                if label[i] != label[j] and how.alike(sets[i], sets[j]):
                    label[label == label[i]] = label[j]
                    out.append((int(ids[i]), int(ids[j])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_units(links, 256), "u long, v long")


def _copies(docs: DataFrame, id_col: str, text_col: str, how: NearCopies) -> DataFrame:
    """key, keep_key, none, keep_id: the texts of groups of two rows or more, with the key and id of the row that stays."""
    points = _points(docs, id_col, text_col, how)
    classes = connected_components(_candidates(points, how))
    links = _confirmed(_members(docs, points, classes, text_col, how), how)
    rows = points.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").where("root is not null or n > 1")
    rows = rows.select("key", "least", F.coalesce("root", "id").alias("root"))
    first = rows.groupBy("root").agg(F.min(F.struct("least.none", "least.doc_id", "key")).alias("first"))
    return materialise(rows.join(first, "root").select("key", F.col("first.key").alias("keep_key"), F.col("first.none").alias("none"), F.col("first.doc_id").alias("keep_id")), narrow=True)


def _with_copies(docs: DataFrame, id_col: str, text_col: str, how: NearCopies) -> DataFrame:
    """key, doc_id, row (all columns of ``docs``), and keep_key, none, keep_id where the text is in a group."""
    copies = _copies(docs, id_col, text_col, how)
    if copies.count() <= 200_000:  # some 80 bytes each
        copies = F.broadcast(copies)
    rows = docs.select(text_key(text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(copies, "key", "left")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: NearCopies = NearCopies()) -> DataFrame:
    """Return doc_id, keep_id, kept: one row per row of ``docs``; keep_id is the smallest id of its group of near-copies.

    Null and empty texts, and texts of white space, are copies of each other, as equal texts are. A null id is larger
    than any other; of equal texts with equal ids all are kept here. Texts of any length count whole. Empty table: empty
    result. Other columns, whatever their names, are not read.
    """
    rows = _with_copies(docs.select(id_col, text_col), id_col, text_col, how)
    alone = F.col("keep_key").isNull()
    kept = alone | ((F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), kept.alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: NearCopies = NearCopies()) -> DataFrame:
    """One row of each group of near-copies, that of the smallest id, and all rows that are in none, with all their columns.

    Cases as in ``near_copies``; of a group's rows that repeat the smallest id and its text, one stays.
    """
    rows = _with_copies(docs, id_col, text_col, how)
    first = rows.where((F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["key"])
    return rows.where("keep_key is null").select("row").union(first.select("row")).select("row.*")
