"""Operators 1, 2, 5 and 7 against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import textwrap

import pytest

from foliant.llm import chunk_dedup, license_texts, licenses, pii, token_counts
from foliant.llm.bpe import Codec
from foliant.llm.queries import VOCABULARY

from .test_ops_a import EDGE, SCHEMA, own_tiktoken


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_base(text):
    text = text or ""

    def luhn(d):
        return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(int(c) for c in reversed(d))) % 10 == 0

    out = []
    for order, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


PII = [
    "a.b+c@x-1.example.com, d@e.f_g@h.i.j @k.l m@n 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.000.1.01 é\U0001F980 x@y.zz",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 1234567890123456789012 4111111111111111+4111 111111111111",
    "+1 (555) 123-4567 +12 +1..........2 +44.20.7946.0958- ++49 30 123456 +1234567890123456 1+23 456 789 012 3",
    "", None, "@" * 50 + "a@b" * 30 + ".c@d.e",
]


def check_base(df, rows):
    got = {}
    for r in pii.pii_report(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text in rows:
        want = brute_base(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        match = [r for r in got[doc_id] if r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()]
        assert match, (doc_id, text[:100], joined, got[doc_id])
        counts = {k: sum(w[3] == k for w in want) for k in pii.KINDS}
        assert [match[0][f"n_{k}"] for k in pii.KINDS] == list(counts.values())
        assert set(joined.split(",")) - {""} <= set(match[0].spans.split(","))


def test_pii_base(spark, sf_dir, edge, empty):
    rnd = random.Random(3)
    rows = list(enumerate(PII)) + [(100 + i, "".join(rnd.choice("1234567890 -.+@ab()") for _ in range(rnd.randrange(80)))) for i in range(400)]
    check_base(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_base(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    check_base(edge, EDGE)
    assert pii.pii_report(empty).count() == 0


def test_pii_disclosing_terms(spark):
    rows = [(i, f"words about Zebediah and 555, mail zeb@example.com please number {i}") for i in range(3)]
    rows += [(10 + i, f"please write words about and number of mail {i} {'zzz' * 3000}") for i in range(40)]
    rows += [(90, "Zebediah alone, without the address")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_spans(df).collect()}
    assert {(t.kind, t.value) for t in got[0].terms} == {("generalise", "Zebediah"), ("remove", "555")}
    assert got[0].sanitised == "words about [NAME] and , mail [EMAIL] please number 0"
    assert not got[90].terms and not got[12].terms and got[90].sanitised == rows[-1][1]
    joined = pii.pii_spans(df, how=pii.Disclosure(broadcast_bytes=0)).collect()  # term counts by key instead
    assert {r.doc_id: r for r in joined} == got


def test_pii_discloses_over_whole_documents(spark):
    far = "filler text of no weight " * 40
    rows = [(i, f"mail zeb@example.com now. {far} Zebediah {far} one two three four five six Quillon") for i in range(2)]
    rows += [(2, f"Quillon {far} mail zeb@example.com now")]  # near it in no document
    rows += [(10 + i, f"{far} mail now one two three four five six") for i in range(40)]
    rows += [(90, "Quillon alone")]
    got = {r.doc_id: r for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t.kind, t.value) for t in got[0].terms] == [("remove", "Zebediah"), ("generalise", "Quillon")]
    assert [(t.kind, t.value) for t in got[2].terms] == [("generalise", "Quillon")] and not got[10].terms and not got[90].terms


def test_token_tree_random_edits():
    codec, enc = Codec.from_file(VOCABULARY), own_tiktoken()
    rnd = random.Random(2)
    for trial in range(150):
        text = "".join(rnd.choice("ab  's\n\t1.ö🦀") for _ in range(rnd.randrange(300)))
        tree = token_counts.TokenTree(text, codec, block=4)
        for _ in range(12):
            a = rnd.randrange(len(text) + 1)
            b = min(len(text), a + rnd.choice((0, 1, 5, 60)))
            new = "".join(rnd.choice("ab  's\n1") for _ in range(rnd.choice((0, 1, 3, 40))))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.n_tokens == len(enc.encode_ordinary(text)), (trial, text)
            assert [t for x in tree.blocks for t in x] == codec.split(text)
    long = "many words of text, " * 5000
    tree = token_counts.TokenTree(long, codec)
    tree.edit(50_000, 50_003, "xyz")
    assert tree.reencoded < 20 and tree.n_tokens == len(enc.encode_ordinary(tree.text()))


def test_edited_counts(spark, sf_dir, edge, empty):
    enc = own_tiktoken()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (docs, edge):
        rows = df.select("doc_id", "text", token_counts.sample_edits().alias("edits")).collect()
        want = []
        for r in rows:
            text = r.text or ""
            n = len(enc.encode_ordinary(text))
            for e in r.edits:
                s = min(max(0, e.start), len(text))
                text = text[:s] + e.replacement + text[max(s, min(e.end, len(text))) :]
            want.append((r.doc_id, n, len(enc.encode_ordinary(text)), 3))
        got = [(r.doc_id, r.n_tokens, r.n_tokens_after, r.n_edits) for r in token_counts.edited_counts(df, token_counts.sample_edits(), VOCABULARY).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.edited_counts(empty, token_counts.sample_edits(), VOCABULARY).count() == 0


def wrapped(text, mark, width=60):
    return "\n".join(mark + line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""])


def test_license_texts():
    scanner = licenses.Scanner()
    three = (
        "Copyright (c) 2019, Jane Roe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.\n\n3. Neither the name of Example Labs nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.\n\n" + license_texts._BSD_ASIS
    )
    two = three[: three.index("3. Neither")] + license_texts._BSD_ASIS
    gpl = (
        "This file is part of Foo.\n\nFoo is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; "
        "either version {} of the License, or (at your option) any later version.\n\nFoo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
    )
    cases = [
        ("BSD-3-Clause", three), ("BSD-2-Clause", two), ("GPL-2.0", gpl.format("General Public License", "2")), ("GPL-3.0", gpl.format("General Public License", "3")),
        ("LGPL-2.1", gpl.format("Lesser General Public License", "2.1")), ("AGPL-3.0", gpl.format("Affero General Public License", "3")),
        ("MIT", license_texts._MIT + license_texts._MIT_NOTICE), ("MIT", "MIT License\n\nCopyright (c) 2020 A B\n\n" + license_texts.TEXTS["MIT"][0]),
        ("ISC", "Copyright 2020 A\n\n" + license_texts.TEXTS["ISC"][0]), ("Apache-2.0", license_texts.TEXTS["Apache-2.0"][0]), ("MPL-2.0", license_texts.TEXTS["MPL-2.0"][0]),
        ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"), ("Apache-2.0,MIT", "SPDX-License-Identifier: (MIT OR Apache-2.0)"),
        ("", "A license to redistribute and use software is a permission that the copyright holder gives, with or without conditions."),
    ]
    for want, text in cases:
        for mark in ("", " * ", "# ", "// "):
            around = "int before;\n" + wrapped(text, mark) + "\nint after;\n" * 3
            found = scanner.scan(around)
            assert ",".join(sorted({f[0] for f in found})) == want, (want, mark, found)
            assert all("before" not in around[a:b] and "after" not in around[a:b] for _, a, b, _, _ in found)


def test_licenses(spark, edge, empty):
    texts = [
        "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-SA 4.0.", "Licensed under the GNU General Public License v2", "He has a driving license for lorries.", "x " * 3000 + "Licensed under CC BY 4.0. Then more." + " y" * 3000, None, "",
        "Licensed under CC BY 4.0.\n" + "z\n" * 20 + "Released under the MIT License.",
    ]
    texts += ["En.\nThis work is licensed under the GNU General Public License, version 3.\nEt.", "Licensed under the terms of the GNU Lesser General Public License version 4."]
    want = ["CC-BY-NC-4.0", "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "CC-BY-SA-4.0", "GPL-2.0", "", "CC-BY-4.0", "", "", "CC-BY-4.0,MIT", "GPL-3.0", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licenses for r in licenses.license_report(df).orderBy("doc_id").collect()] == want
    spans = licenses.license_scan(df).where("doc_id = 0").collect()
    assert [texts[0][r.start : r.end] for r in spans] == ["Licensed under CC BY-NC 4.0"]
    assert licenses.license_report(edge).count() == len(EDGE) and licenses.license_report(empty).count() == 0


def test_whole_license_texts():
    scanner = licenses.Scanner()
    for name, (text,) in license_texts.whole_texts().items():
        before = "int before;\n" * 50
        found = scanner.scan(before + text + "\nint after;\n" * 50)
        assert found and found[0][0] == name and found[0][3] > 0.99, (name, [f[:4] for f in found])
        assert found[0][1] - len(before) < 80 and found[0][2] > len(before) + 0.99 * len(text.rstrip()), (name, found[0][:4])


def test_licenses_against_brute_force():
    """All windows compressed with all templates, no window left out."""
    given = {k: v for k, v in licenses.all_templates().items() if k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "GPL-2.0", "GPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "Proprietary")}
    scanner = licenses.Scanner(given)
    rng = random.Random(3)
    vocabulary = [w for vs in given.values() for v in vs[:3] for w in v.split()][:600] + ["of the", "license", "prose", "zaś"]
    for case in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            wording = rng.choice([v for vs in given.values() for v in vs if len(v) < 4000]).split()
            at = rng.randrange(len(wording)) if rng.random() < 0.3 else 0
            kept = [rng.choice(vocabulary) if rng.random() < 0.06 else w for w in wording[at:] if rng.random() > 0.04]
            parts += rng.choices(vocabulary, k=rng.randrange(60)) + kept
        text = " ".join(parts)
        assert scanner.scan(text) == scanner.scan(text, every=True), case
        assert case or scanner.scan(text.replace(" ", "\n# ")) is not None
    for text in ("", "x", "İ K ẞ", "All rights reserved", "all rights reserved " * 3):
        assert scanner.scan(text) == scanner.scan(text, every=True)
    assert len(scanner.scan("All rights reserved. " * 3)) == 3


def brute_chunks(rows, how=chunk_dedup.Chunking()):
    gear = how.gear()
    parts = {}
    for key in set(rows):
        raw, start = (key[1] or "").encode(), 0
        parts[key] = [raw[a:b] for a, b in zip([0, *chunk_dedup.cuts(raw, how, gear)], chunk_dedup.cuts(raw, how, gear))]
    count, owner = {}, {}
    for key, pieces in parts.items():
        for p in pieces:
            count[p] = count.get(p, 0) + 1
            rank = key[0] if key[0] is not None else 1 << 63
            owner[p] = min(rank, owner.get(p, rank))
    out = []
    for key in rows:
        kept, seen = [], set()
        for p in parts[key]:
            if count[p] == 1 or (owner[p] == (key[0] if key[0] is not None else 1 << 63) and p not in seen):
                kept.append(p)
                seen.add(p)
        n = len((key[1] or "").encode())
        out.append((key[0], n, len(parts[key]), sum(len(p) for p in parts[key] if count[p] > 1), n - len(b"".join(kept)), hashlib.sha256(b"".join(kept)).hexdigest()))
    return out


def test_gear_cuts():
    how = chunk_dedup.Chunking()
    gear = how.gear()
    rnd = random.Random(9)
    raw = bytes(rnd.randrange(97, 123) for _ in range(20_000))
    h = 0
    want, last = [], 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        if h < 1 << 26 and i + 1 - last >= how.least:
            want.append(i + 1)
            last = i + 1
    got = chunk_dedup.cuts(raw, how, gear)
    assert set(want[-20:]) <= set(got) and got[-1] == len(raw) and max(b - a for a, b in zip([0, *got], got)) <= how.most
    shifted = chunk_dedup.cuts(b"inserted" + raw, how, gear)
    assert len({c - 8 for c in shifted} & set(got)) > 0.95 * len(got)


def test_chunk_dedup(spark, sf_dir, edge, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]), (edge, EDGE)):
        got = [tuple(r) for r in chunk_dedup.chunk_dedup_digests(df).collect()]
        assert sorted(got, key=str) == sorted(brute_chunks(rows), key=str)
    assert chunk_dedup.chunk_dedup_digests(empty).count() == 0
