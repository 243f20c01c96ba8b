"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import cleaning, text


def evaluate(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_titles(spark):
    assert evaluate(spark, text.strip_numeric_prefix, ["1.2 Title", "5 Foo", "Foo 5", " 3.1.4  Pi ", "1 Foo\nx"]) == ["Title", "Foo", "Foo 5", "Pi", "1 Foo\nx"]
    titles = ["Part I: Intro", "I. Data", "1. The Model", "12 Overview", "Just a Title", "Part 1.2 Title", "CZĘŚĆ ii - x", "", None, "Chapter 7"]
    assert evaluate(spark, text.part_number, titles) == ["I", "I", "1", "12", None, None, "II", None, None, "7"]
    stripped = ["Intro", "Data", "The Model", "Overview", "Just a Title", "2 Title", "- x", "", None, "Chapter 7"]
    assert evaluate(spark, text.strip_part_prefix, titles) == stripped
    assert [tuple(r) for r in evaluate(spark, text.parse_major_minor, ["3.7 x", "4", "x 4", " 12.x"])] == [(3, 7), (4, None), (None, None), (12, None)]


def test_roman_and_letters(spark):
    numbers = [1, 4, 9, 40, 90, 400, 900, 1994, 3999]
    roman = evaluate(spark, text.to_roman, numbers, "int")
    assert roman[-2:] == ["MCMXCIV", "MMMCMXCIX"]
    assert evaluate(spark, text.from_roman, roman) == numbers
    assert evaluate(spark, text.from_roman, ["iv", "IIX", "ABC", "", None]) == [4, 10, None, None, None]
    with pytest.raises(Exception, match="between 1 and 3999"):
        evaluate(spark, text.to_roman, [4000], "int")
    assert evaluate(spark, text.base26, [0, 1, 26, 27, 702, 703, None], "int") == ["", "a", "z", "aa", "zz", "aaa", None]


def test_references(spark):
    hrefs = ["a.xhtml#x", "a.xhtml", "a#b#c", "#x", "a#"]
    assert evaluate(spark, text.href_file, hrefs) == ["a.xhtml", "a.xhtml", "a", "", "a"]
    assert evaluate(spark, text.href_fragment, hrefs) == ["x", None, "b", "x", ""]
    assert evaluate(spark, text.is_html_file, ["A.XHTML", "b.htm", "c.html", "d.xhtm", "e.css"]) == [True, True, True, False, False]
    assert evaluate(spark, text.extension_of_path, ["a/b.PNG", "c.jpeg", "d.svg", "e.txt", ".png", "x.y/z"]) == ["png", "jpg", "svg", None, None, None]
    assert evaluate(spark, text.extension_of_mime, ["image/JPEG; q=1", "image/svg+xml", "text/html"]) == ["jpg", "svg", None]
    assert evaluate(spark, text.heading_level, ["h1", "H6", "h7", "hr", "html", "p"]) == [1, 6, 7, None, None, None]
    assert evaluate(spark, text.base_name, ["a/b.c.d", "x"]) == ["b", "x"]


CORPUS = [
    "", " ", "\n\n", "plain text", "two  spaces\tand tabs", "po-\nkojowo i po-\nkojowo", "a-\nb-\nc", "line one\nline two\nline three\nline four",
    "x a\nbc d", "Ends here.\nStarts there", "code   indent\n    kept?\n\n\n\nend", "\uE000\uE003\uE004 \uE000 \uE01B\uE999", "\uFEFFbom\r\nnext\r\n",
    "nbsp\u00A0\u00A0x\n\u00A0\u00A0y\u00A0", "\u00A0 \n\u00A0", "emoji 🦀 ok\nno", "historii\ndla oświaty\ni", "ctl\x00\x01\x0b\x7fchars", "tab\t\n\tx", "ß\nab Straß\nx", "śa\nb A\nb",
    "end\u2003\nnext line \u2003\nmore", "a\nb\nc\nd", "1\n2\na\n b \nc.", "x" * 5000 + "\n" + " y" * 3000,
]


def test_cleaning_agrees_with_kernel(spark):
    assert evaluate(spark, text.clean_text, CORPUS) == [cleaning.clean(t)[0] for t in CORPUS]
    assert evaluate(spark, lambda c: text.clean_text(c, fix_breaks=False), CORPUS) == [cleaning.clean(t, fix_breaks=False)[0] for t in CORPUS]
    assert evaluate(spark, text.clean_whitespace, CORPUS) == [cleaning.clean_whitespace(t) for t in CORPUS]
    assert evaluate(spark, text.clean_extracted_text, CORPUS) == [cleaning.clean_extracted(t) for t in CORPUS]


def test_cleaning_examples(spark):
    got = dict(zip(CORPUS, evaluate(spark, text.clean_text, CORPUS)))
    assert got["po-\nkojowo i po-\nkojowo"] == "pokojowo i pokojowo"
    assert got["a\nb\nc\nd"] == "a bc d"
    assert got["\u00A0 \n\u00A0"] == "" and got["\uE000\uE003\uE004 \uE000 \uE01B\uE999"] == "CD Z"
    assert evaluate(spark, text.clean_text, [None]) == [None]
    assert evaluate(spark, text.clean_whitespace, ["a  b\n c   d \n\n e f"]) == ["a\nb\nc\nd\ne f"]


def test_ranges(spark):
    rows = [([(0, 2), (2, 5)], 5), ([(0, 2), (1, 5)], 5), ([(3, 3)], 5), ([(0, 6)], 5), ([], 0), ([(4, 5), (0, 1)], 5)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(rows)], "i int, r array<struct<start:int,end:int>>, n int")
    got = [r.ok for r in df.select("i", text.valid_preserved(F.col("r"), F.col("n")).alias("ok")).orderBy("i").collect()]
    assert got == [True, False, False, False, True, False]
    one = spark.range(1).select(F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"))).alias("p"))
    span = F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))
    inside = F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"))
    assert tuple(one.select(text.straddles(span, F.col("p")), text.straddles(inside, F.col("p")), text.range_contains(span, F.lit(3))).first()) == (True, False, False)


def test_long_runs_of_spaces_take_linear_time(spark):
    import time

    rules = [text.clean_text, text.normalize_whitespace, text.clean_whitespace, text.clean_extracted_text, text.match_form, text.trimmed]
    for run in (" ", "\t", "a ", "\u00A0", " \n"):
        df = spark.createDataFrame([("x" + run * 200_000 + "y",)], "t string")
        for rule in rules:
            rule_of = df.select(rule(F.col("t")).alias("r"))
            rule_of.collect()
            began = time.time()
            rule_of.collect()
            assert time.time() - began < 3, (rule.__name__, run)
