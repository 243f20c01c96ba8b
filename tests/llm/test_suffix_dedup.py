"""Operator 8 against a brute-force version."""

import hashlib
import random
from collections import Counter

import pytest

from foliant.llm.suffix_dedup import Repeats, suffix_dedup_digests

from .test_ops_a import EDGE, SCHEMA


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def check(df, rows, how):
    got = [tuple(r) for r in suffix_dedup_digests(df, how=how).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, how.length), key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()], Repeats())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_small_strings(spark, seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abcé \n") for _ in range(rnd.randrange(10, 90))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.7 else rnd.choice("xyz") * rnd.randrange(40) for _ in range(rnd.randrange(9)))) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, Repeats(length=40, gram=6))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr("foliant.llm.suffix_dedup._PIECE", 5000)
    unique = "".join(random.Random(4).choice("abcdefgh") for _ in range(30_000))
    rows = EDGE + [(20, unique), (21, "q" * 399), (22, "q" * 400), (23, "r" * 401), (24, unique[100:499]), (25, unique[9_900:10_300])]
    rows = [(i, t if t is None or len(t) < 50_000 else t[:20_000]) for i, t in rows]
    df = spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    check(df, rows, Repeats())
    assert suffix_dedup_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_passage_in_many_contexts(spark, monkeypatch):
    """A passage of one rank in more spans than a part holds, some of them copies, and lone windows beside it."""
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(55))
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(rnd.randrange(60))) + passage[: 55 - i % 3] + "".join(rnd.choice("uvw") for _ in range(rnd.randrange(60)))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    how = Repeats(length=40, gram=6)
    from foliant.llm import suffix_dedup

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda keyed, how: plain(keyed, how, 7))
    check(df, rows, how)


def test_too_long_for_runs():
    with pytest.raises(ValueError, match="1,024"):
        Repeats(length=3000)
