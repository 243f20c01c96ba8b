"""The pipeline against a version that works in plain Python."""

import hashlib
import random
import re

import numpy as np
import corpus_pipeline
import pytest

from foliant.llm import pipeline, simhash, toxicity

from .test_ops_a import brute_contamination


def test_run_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = [(i, t) for i, t in docs if model.score(t or "") < 0.5]
    first = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    left = list(first.values())
    stay = set(brute_near(left))
    left = [r for r in left if r[0] in stay]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    left = [r for r, c in zip(left, brute_contamination(left, items)) if not c[5]]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left)


LONG = " ".join(f"w{i}" for i in range(100_000))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (1, None), (None, "a b c"), (2, "a b c"), (2, "other words in this row"), (None, None), (3, LONG), (4, LONG + " with an end"), (5, "x" * 300_000)],
    ],
)
def test_stages_keep_columns(spark, sf_dir, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars", "keep_id", "digest", "key", "row", "__id", "k0", "id", "node", "root", "a b", "dotted.name"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *"123456789ab") for i, t in rows], ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(tuple(r)[5:] == tuple("123456789ab") for r in docs.collect())
    assert sorted(r[0] for r in docs.collect()) == ([1, 2, 2, 3, 5] if rows else [])


def test_run_deletes_what_it_no_longer_needs(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "shared_folder", lambda _: str(tmp_path))
    stages = [("a", lambda s, d, f: d.limit(9)), ("b", lambda s, d, f: d.limit(5)), ("c", lambda s, d, f: d.limit(3)), ("d", lambda s, d, f: d.limit(2))]
    assert pipeline.run(spark, sf_dir, stages).count() == 2
    assert [p.name for p in next(tmp_path.iterdir()).iterdir()] == ["c"]


def brute_near(rows, width=5):
    sets = []
    for _, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * same >= 4 * (len(sets[i]) + len(sets[j]) - same):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root[i]] = min(doc_id, least.get(root[i], doc_id))
    return sorted(least.values())


def groups(rnd, n_groups, each, edits, common):
    rows = []
    for g in range(n_groups):
        base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        for k in range(each):
            words = list(base)
            for _ in range(rnd.randrange(edits)):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(3000)}"
            rows.append((len(rows), common + " ".join(words[: len(words) - rnd.randrange(12)])))
    return rows


@pytest.mark.parametrize("how", [simhash.NearCopies(), simhash.NearCopies(class_rows=5, bucket_rows=2), simhash.NearCopies(class_bytes=4000)])
def test_near_copies_equal_brute_force(spark, sf_dir, how):
    rows = groups(random.Random(9), 6, 12, 5, "the same common line stands in every one of these texts ")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs, [tuple(r) for r in docs.collect()])):
        want = brute_near(texts)
        assert sorted(r.doc_id for r in simhash.without_near_copies(df, how=how).collect()) == want and len(want) < len(texts)
        assert sorted(r.doc_id for r in simhash.near_copies(df, how=how).collect() if r.kept) == want


def test_near_copies_in_one_large_group(spark):
    rows = groups(random.Random(3), 1, 600, 4, "")
    how = simhash.NearCopies(class_rows=64, bucket_rows=16)
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), how=how)
    assert sorted(r.doc_id for r in got.collect()) == brute_near(rows)


def test_wide_planes_equal_counting():
    rnd = np.random.RandomState(2)
    values = rnd.randint(0, 1 << 63, size=(150, 2), dtype=np.uint64)
    values[1::3] = values[::3] ^ (np.uint64(1) << rnd.randint(0, 64, size=(50, 2)).astype(np.uint64))
    bits = np.unpackbits(values.view(np.uint8), axis=1)
    away = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    for radius in (0, 2, 26, 55):
        got = {(i, int(j)) for i, near in simhash.near_pairs(values, radius) for j in near}
        assert got == {(i, j) for i in range(150) for j in range(i) if away[i, j] <= radius}
