"""Edit scripts: offsets follow the text, preserved ranges survive."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions.cleaning import EditScript, clean, clean_around, diff, from_units, identity, moved, preserved_form, units
from foliant.operators import edits


def test_map_examples():
    script = EditScript([("keep", 0, 3, 0, 3), ("delete", 3, 5, 3, 0), ("replace", 5, 8, 3, 2), ("keep", 8, 10, 5, 2)], 10, 7)
    assert [script.map_start(i) for i in range(11)] == [0, 1, 2, 3, 3, 3, 3, 3, 5, 6, 7]
    assert [script.map_end(i) for i in range(11)] == [0, 1, 2, 3, 3, 3, 5, 5, 5, 6, 7]
    for bad in (-1, 11):
        with pytest.raises(IndexError):
            script.map_start(bad)
        with pytest.raises(IndexError):
            script.map_end(bad)
    assert identity(0).edits == [] and identity(4).map_start(2) == 2


def test_diff_forms():
    assert [e[0] for e in diff("a  b", "a b").edits] == ["keep", "replace", "keep"]
    assert [e[0] for e in diff(" a", "a").edits] == ["delete", "keep"]
    coarse = diff("po-\nko x", "poko x")
    assert coarse.map_start(6) == 4 and [e[0] for e in coarse.edits] == ["keep", "delete", "keep"]
    insertion = diff("a b", "a X b")
    assert insertion.edits == [("keep", 0, 2, 0, 2), ("keep", 2, 3, 4, 1)] and insertion.length_out == 5


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc 0123 \t\n ", max_size=64), st.integers(0, 1 << 30))
def test_preserved_ranges_survive(text, seed):
    rnd, ranges, at = random.Random(seed), [], 0
    for _ in range(rnd.randrange(3)):
        start = at + rnd.randrange(8)
        end = start + rnd.randrange(1, 7)
        if end <= len(text):
            ranges.append((start, end))
            at = end
    out, script = clean_around(text, ranges)
    kept = moved(ranges, script)
    assert [out[a:b] for a, b in kept] == [preserved_form(text[a:b]) for a, b in ranges]
    assert script.length_out == len(out)


def test_examples():
    assert clean_around("aa\n\n\n[X]\n\n\nbb", [(5, 8)])[0] == "aa\n\n[X]\n\nbb"
    assert clean("    x = 1\n")[0] == "    x = 1"
    assert from_units(units("a\U0001f980b")) == "a\U0001f980b" and len(units("a\U0001f980b")) == 4


def test_columns_agree_with_kernel(spark):
    texts = ["aa  bb\n\n\n\ncc", " x a\nbc ", "po-\nkojowo", "", None, "\x07\x07 gone", "a\U0001f980  b\tc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    df = edits.cleaned_with_script(rows, "id", "t").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length_in"))))
    args = [F.col(c) for c in ("edits", "length_in", "length_out", "at")]
    for r in df.select("id", "at", edits.map_start(*args).alias("s"), edits.map_end(*args).alias("e")).collect():
        script = clean(units(texts[r.id] or ""))[1]
        assert (r.s, r.e) == (script.map_start(r.at), script.map_end(r.at)), (texts[r.id], r)
    around = spark.createDataFrame([(1, "aa\n\n\n[\t]\n\n\nbb", [(5, 8)])], "id int, t string, p array<struct<start:int,end:int>>")
    got = edits.cleaned_around(around, "id", "t", "p").first()
    assert got.text == "aa\n\n[    ]\n\nbb" and tuple(got.preserved[0]) == (4, 10)


def test_ranges_of_elements(spark):
    df = spark.sql("select from_json('[{\"node_id\":3,\"tag\":\"li\",\"ranges\":[{\"start\":1,\"end\":2}]}]', 'array<struct<node_id:int,tag:string,ranges:array<struct<start:int,end:int>>>>') e")
    row = df.select(edits.ranges_of(F.col("e"), F.lit(9)).alias("none"), edits.single_range_of(F.col("e"), F.lit(3)).alias("one")).first()
    assert row.none == [] and tuple(row.one) == (1, 2)
    with pytest.raises(Exception, match="exactly one range"):
        df.select(edits.single_range_of(F.col("e"), F.lit(9))).collect()


def test_moves_only():
    """Edits that don't tell words apart that stay: as few as there are empty lines, and every offset moved the same."""
    for text, kept in [
        ("One word here\n\n\n\nand more.\n\n\ncode\tx\n\n\n\nLast words\n\n\n", [(31, 37)]),
        ("a b\n\n\n c d", []),
        ("\n\n\n", []),
        ("a\tb\n\n\n\nC", []),
        ("low\nlow\n\n\n\nC", []),
        ("x\n\n\ny", [(1, 4)]),
    ]:
        (one, words), (other, moves) = clean_around(text, kept), clean_around(text, kept, moves_only=True)
        assert one == other
        for i in range(len(text) + 1):
            assert (words.map_start(i), words.map_end(i)) == (moves.map_start(i), moves.map_end(i))
    text = "many words on a line\n\n\nand on another"
    assert len(clean_around(text, [], moves_only=True)[1].edits) == 3 < len(clean_around(text, [])[1].edits)
