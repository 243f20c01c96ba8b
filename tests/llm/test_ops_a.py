"""Operators 3, 4, 6, 9 and 10 against brute-force versions, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from foliant.llm import bpe, components, decontamination, exact_dedup, simhash, toxicity
from foliant.llm.common import forget, map_texts, materialise
from foliant.llm.queries import QUERIES, VOCABULARY

SCHEMA = "doc_id long, text string, lang string, keep_id string, fp string, n_tokens string"
LONG = "lorem ipsum dolor " * 9000 + "x" * 60_000
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "a  b"), (5, "a  b"), (6, "a\tb "), (None, "a b"), (None, None),
    (7, "Tom's 12 cats<|endoftext|>  \n\n émigré 🦀 <b>"), (8, LONG), (9, LONG), (10, "A B C"), (11, "a b c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def own_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, sf_dir, edge):
    enc = own_tiktoken()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((edge, EDGE), (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        want = []
        for i, t in rows:
            ids = enc.encode_ordinary(t or "")
            raw = np.array(ids, dtype="<u4").tobytes()
            want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        got = [tuple(r) for r in bpe.bpe_digests(df, VOCABULARY).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_random_bytes_and_hash():
    codec, enc = bpe.Codec.from_file(VOCABULARY), own_tiktoken()
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("aeth  in'sé\n\t12.🦀ö") for _ in range(rnd.randrange(60)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == enc.encode_ordinary(t)
    tokens = list(codec.ranks)
    assert len({codec.table.find(t) for t in tokens}) == len(tokens) and codec.table.find(b"no such token at all") == -1


def test_bpe_rows(edge, empty):
    full = {str(r.doc_id): r for r in bpe.bpe_encode(edge, VOCABULARY).collect() if r.doc_id is not None}
    assert full["7"].decoded.decode() == EDGE[9][1] and full["1"].ids == []
    assert bpe.bpe_digests(empty, VOCABULARY).count() == 0


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=3):
    fps = [brute_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    return [(doc_id, f"{fps[i]:016x}", ids.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def test_simhash_equals_brute_force(spark, sf_dir, edge, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((edge, EDGE), (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        got = [tuple(r) for r in simhash.simhash_groups(df, chunk_rows=8).collect()]
        assert sorted(got, key=str) == sorted(brute_groups(rows), key=str)
    assert simhash.simhash_groups(empty).count() == 0


def test_near_pairs_and_links(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = np.array(sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for b in base for _ in range(25)}), dtype=np.uint64)
    for radius in (0, 1, 3, 6):
        got = {(i, int(j)) for i, near in simhash.near_pairs(values, radius) for j in near}
        want = {(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert got == want
    signed = [int(v) for v in values.view(np.int64)]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk_rows=16)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    index = {v: i for i, v in enumerate(signed)}
    for i, near in simhash.near_pairs(values, 3):
        assert all(got[signed[i]] == got[signed[j]] for j in near)
    assert all(a in index and b in index for a, b in got.items())


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150))


def test_components_write_little(spark, monkeypatch):
    """Links that are stars take no round; what is written to be read again has few parts, however many the shuffle has."""
    made = []
    monkeypatch.setattr(components, "materialise", lambda *a, **b: made.append(materialise(*a, **b)) or made[-1])
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stars = [(100 * k, 100 * k + i) for k in range(3) for i in range(1, 40)]
        got = {tuple(r) for r in components.connected_components(spark.createDataFrame(stars, "u long, v long")).collect()}
        assert got == {(100 * k + i, 100 * k) for k in range(3) for i in range(40)}
        assert len(made) == 1 and made[0].rdd.getNumPartitions() == 32
        tangled = [(5, 1), (5, 2), (5, 9), (2, 8), (20, 21), (22, 21), (30, 31)]
        got = {tuple(r) for r in components.connected_components(spark.createDataFrame(tangled, "u long, v long")).collect()}
        assert got == {(1, 1), (2, 1), (5, 1), (8, 1), (9, 1), (20, 20), (21, 20), (22, 20), (30, 30), (31, 30)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_components_equal_brute_force(spark):
    rnd = random.Random(3)
    for n, m in ((60, 25), (60, 55), (60, 120)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for _ in links:
            for u, v in links:
                root[u] = root[v] = min(root[u], root[v])
        got = sorted(map(tuple, components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()))
        assert got == sorted((x, root[x]) for x in {y for u, v in links if u != v for y in (u, v)})


def test_workers_forget_the_codec(spark):
    """A worker that goes on to another operator's task doesn't hold the memo of pre-tokens any more."""
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    bpe.bpe_digests(docs, VOCABULARY).collect()

    def held(rows):
        from foliant.llm import bpe

        yield len(bpe._CODECS), len(rows)

    rows = map_texts(docs, held, "n long, rows long").collect()
    assert sum(r.rows for r in rows) == 64 and not any(r.n for r in rows)
    codec = bpe.Codec([bytes([b]) for b in range(256)], list(range(256)), P.PATTERN)
    bpe._CODECS["test"] = codec
    codec.encode("some words"), codec.counts(["some"])
    forget()
    assert not bpe._CODECS and not codec.packed and not codec.lengths and codec.encode("ab") == bytes([97, 0, 0, 0, 98, 0, 0, 0])


def test_exact_dedup_edges(edge, empty):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    want = []
    for i, t in EDGE:
        group = [j for j, u in EDGE if norm(u) == norm(t)]
        keep = min((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for runs, fan_in in ((64, 8), (5, 2), (1, 2)):
        got = [tuple(r) for r in exact_dedup.exact_dedup(edge, runs=runs, fan_in=fan_in).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_contamination(docs, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = []
    for item, t in items:
        w = words(t)
        n = min(width, len(w))
        wins += [(str(item), w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, win in wins:
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, empty):
    item = "One two three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "tiny Item"), (3, None), (4, "..."), (10, "tiny item")]
    docs = [
        (1, "x " + item.upper() + " y"), (2, "tiny-item; tiny item"), (3, None), (4, ""), (5, "one two three four five six seven eight nine"),
        (6, "a" * 90_000 + " " + item.replace(" ", "\n--\n") + " ünï"), (None, "tiny item"), (6, "clean words only"), (6, "clean words only"),
    ]
    df = spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 4):
        if most == 4:  # beyond the bound no window comes to the driver
            assert decontamination._small(decontamination._items(bench, "item_id", "text"), 10, most) is None
        got = [tuple(r) for r in decontamination.contamination(df, bench, max_windows=most).collect()]
        assert sorted(got, key=str) == sorted(brute_contamination(docs, items), key=str)
    assert decontamination.contamination(empty, bench).count() == 0
    none = decontamination.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)
    for most in (200_000, 4):
        left = decontamination.decontaminated(df, bench, max_windows=most)
        assert left.columns == df.columns and sorted(r.text for r in left.where("text is not null").collect()) == [
            "", "clean words only", "clean words only", "one two three four five six seven eight nine",
        ]
        cut = {r.doc_id: r.text for r in decontamination.decontaminated(df, bench, mode="span", max_windows=most).collect()}
        assert cut[1] == "x  y" and cut[3] is None and cut[2] == "" and len(cut) == 7


def test_decontamination_beyond_the_bound(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    assert want == sorted(map(tuple, decontamination.contamination(docs, bench, max_windows=10).collect())) and any(r[5] for r in want)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_toxicity"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    both = got.merge(labels, on="doc_id")
    test = both[both.held_out]
    assert (test.predicted == test.toxic).mean() > 0.9
    clean = both[both.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.97


def test_toxicity_score_equals_brute_force():
    rnd = random.Random(8)
    words = ["good", "fine", "schön", "плохой", "awful", "idiot", "день", "the", "and"]
    texts = [" ".join(rnd.choice(words[:4] + words[6:] if i % 2 else words) for _ in range(30)) for i in range(60)]
    toxic = [int("idiot" in t or "awful" in t) for t in texts]
    sizes, bits = (2, 3), 12
    model = toxicity.fit_texts(texts, toxic, sizes, bits, keep=300, rounds=60)

    def place(gram):
        h = 0
        for n, c in enumerate(gram, start=1):
            h = (h + ord(c)) * int(toxicity._FACTORS[n]) & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)

    for text in [*texts, "", "x", "ПЛОХОЙ День " * 500]:
        padded = f" {text.lower()} "
        seen = {place(padded[i : i + n]) for n in sizes for i in range(len(padded) - n + 1)}
        total = model.bias + sum(float(model.weights[model.place[h]]) for h in seen if model.place[h] >= 0)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in zip(texts, toxic)) >= 57


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(7, 1), (8, 0), (10, None), (None, 1), (4, 5)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    assert toxicity.toxicity_scores(edge, model).count() == len(EDGE)
    assert toxicity.toxicity_scores(empty, toxicity.fit(empty, labels)).count() == 0
    blank = toxicity.fit(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score == pytest.approx(0.25) for r in toxicity.toxicity_scores(edge, blank).collect())
