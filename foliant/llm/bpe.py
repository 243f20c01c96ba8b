"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a token itself. Tier two: misses
are merged over linked bytes with a heap of (rank, position). A worker remembers recent pre-tokens in a memo of
bounded size. The vocabulary has a fixed size (tens of thousands of tokens), read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FORGET, map_texts, whole_text

#: Pre-tokens in each of a memo's two generations (about 200 bytes each), and characters of one that is remembered.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64


class MinimalPerfectHash:
    """Maps each of n keys to its own slot in 0..n-1 (hash and displace); other keys are told apart by comparison."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.buckets = max(1, n // per_bucket)
        grouped: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            grouped.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(i)
        self.seeds = [0] * self.buckets  # below 0: the slot itself, as -slot - 1
        self.keys: list[bytes] = [b""] * n
        self.values = [-1] * n
        free = np.ones(n, dtype=bool)
        for bucket, members in sorted(grouped.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            seed = 1
            while True:
                slots = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for i, slot in zip(members, slots):
                free[slot], self.keys[slot], self.values[slot] = False, keys[i], i
        left = iter(np.flatnonzero(free).tolist())
        for bucket, members in grouped.items():
            if len(members) == 1:
                slot = next(left)
                self.seeds[bucket], self.keys[slot], self.values[slot] = -slot - 1, keys[members[0]], members[0]

    def find(self, key: bytes) -> int:
        """The index of ``key`` among the keys, or -1."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        if seed < 0:
            slot = -seed - 1
        elif seed:
            slot = xxhash.xxh3_64_intdigest(key, seed) % len(self.keys)
        else:
            return -1
        return self.values[slot] if self.keys[slot] == key else -1


class _Memo(dict):
    """What ``make`` gives for a pre-token, remembered in two generations: the young one ages when it is full, and what
    is asked for again moves back, so that frequent pre-tokens are never forgotten all at once."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, token: str):
        out = self.old.get(token)
        if out is None:
            out = self.make(token)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[token] = out
        return out


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str):
        self.table = MinimalPerfectHash(tokens)
        self.ids = ids
        self.ranks = dict(zip(tokens, ids))
        self.bytes_of = dict(zip(ids, tokens))
        self.pairs = [-1] * 65_536  # ranks of two bytes, the first times 256
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.packed = _Memo(lambda token: array("I", self.ids_of(token)).tobytes())
        self.lengths = _Memo(lambda token: len(self.ids_of(token)))

    @classmethod
    def from_file(cls, path: str, pattern: str | None = None) -> Codec:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs], pattern or public_tokenizers.PATTERN)

    def __reduce__(self):
        order = list(self.ranks)
        return _codec, (order, [self.ranks[t] for t in order], self.split.__self__.pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
        n, rank_of, pairs, single = len(piece), self.ranks.get, self.pairs, self.single
        pair = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # of the part that starts here and the next
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        out = [single[b] for b in piece]  # ids of parts; -1 inside one
        if not heap:
            return out
        pair.append(-1)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if pair[i] != rank:
                continue
            gone = ends[i]
            ends[i] = end = ends[gone]
            pair[gone], out[gone], out[i] = -2, -1, rank
            if end < n:
                before[end] = i
                pair[i] = r = rank_of(piece[i : ends[end]], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = r = rank_of(piece[left:end], -1)
                if r >= 0:
                    push(heap, r << 32 | left)
        return [x for x in out if x >= 0]

    def ids_of(self, token: str) -> list[int]:
        """Ids of one pre-token, by the minimal perfect hash or else by merging."""
        piece = token.encode()
        at = self.table.find(piece)
        return [self.ids[at]] if at >= 0 else self.merge(piece)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def counts(self, tokens: list[str]) -> list[int]:
        """The number of ids of each pre-token."""
        return list(map(self.lengths.__getitem__, tokens))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_CODECS: dict[tuple[bytes, str], Codec] = {}


def _codec(tokens: list[bytes], ids: list[int], pattern: str) -> Codec:
    """One codec for a vocabulary and process, so that its memo lasts from task to task."""
    key = (hashlib.sha256(repr((tokens, ids)).encode()).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(tokens, ids, pattern)
    return _CODECS[key]


def _forget() -> None:
    """Drop the process's codecs and what their memos hold, some 100 MB when full."""
    while _CODECS:
        codec = _CODECS.popitem()[1]
        for memo in (codec.packed, codec.lengths):
            memo.clear()
            memo.old.clear()


FORGET.append(_forget)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, ids (array<long>), decoded (binary): one row per row of ``docs``; cases as in ``bpe_digests``."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec.from_file(path))

    def run(rows: list[tuple], codec: Codec) -> Iterator[tuple]:
        for doc_id, text in rows:
            packed = codec.encode(text)
            yield doc_id, np.frombuffer(packed, dtype="<u4").tolist(), codec.decode(packed)

    return map_texts(_texts(docs, id_col, text_col), run, "doc_id long, ids array<long>, decoded binary", lambda: shared.value)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_tokens, ids_sha256, decoded_sha256: ``bpe_encode`` with its ids and bytes digested in place.

    One row per input row, in one pass without an exchange. Null and empty texts have no tokens and the digests of
    no bytes; very long texts and pre-tokens are encoded whole (the heap keeps them at n log n); strings of special
    tokens are ordinary text; repeated rows repeat. Other columns are not read. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec.from_file(path))

    def run(rows: list[tuple], codec: Codec) -> Iterator[tuple]:
        for doc_id, text in rows:
            packed = codec.encode(text)
            yield doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(packed)).hexdigest()

    return map_texts(
        _texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: shared.value
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
