"""Archives, guards, books, figures: on archives made here."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions.media import decode_data_uri, decode_numeric, resolve, safe_svg
from foliant.operators import books, figures, pages, toc
from foliant.plans.archives import archive
from foliant.sources import epub
from foliant.sources.guards import GuardError, Limits, check

PNG = b"\x89PNG\r\n\x1a\n"
CHAPTER = (
    '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>'
    '<h1 id="h.partA">Part A</h1><p>Part A intro, with enough words to be annotated as a section of its own.</p>'
    '<h2 id="h.secA">Section A1</h2><p>Section A1 body <b>bold</b> and long enough to carry annotations, too.</p>'
    '<h1 id="h.partB">Part B</h1><p>Part B intro.</p>{images}</body></html>'
)


def make(title="Book", images="", files=None):
    chapters = [("c1.xhtml", "One", CHAPTER.format(images=images)), ("c2.xhtml", "Two", "<html><body><h1>Loose</h1><p>Spine only.</p></body></html>")]
    entries = [(0, "Part A", "c1.xhtml#h.partA"), (1, "Section A1", "c1.xhtml#h.secA"), (0, "Part B", "c1.xhtml#h.partB"), (0, "Gone", "none.xhtml")]
    return archive(title, chapters, entries, files or {})


@pytest.fixture(scope="module")
def library(spark):
    wrapper = archive(
        "My Book",
        [("c0.xhtml", "x", "<html><body><p>Preface words that wrap.</p></body></html>"), ("c1.xhtml", "x", CHAPTER.format(images=""))],
        [(0, "My  book", "c0.xhtml"), (1, "Part A", "c1.xhtml#h.partA"), (1, "Part B", "c1.xhtml#h.partB")],
        {},
    )
    rows = [("good", make()), ("wrapped", wrapper), ("bad", b"not a zip"), ("none", None)]
    return epub.book_tables(spark.createDataFrame(rows, "path string, content binary"))


def test_tables(library):
    got = {r.book_id: r for r in library["books"].collect()}
    assert got["good"].title == "Book" and got["good"].author == "Nobody" and got["good"].guard_error is None
    assert "End-Of-Central-Directory" in got["bad"].guard_error and "EPUB_MAX_BYTES" in got["none"].guard_error
    entries = [(r.depth, r.title, r.href) for r in library["toc"].where("book_id = 'good'").orderBy("pos").collect()]
    assert entries[1] == (1, "Section A1", "c1.xhtml#h.secA") and len(entries) == 4


def test_chapters_and_sections(library):
    made = books.extract(library)
    chapters = made.chapters.where("book_id = 'good'").orderBy("spine_index").collect()
    assert [(c.file, c.spine_index, c.title) for c in chapters] == [("c1.xhtml", 0, "Part A"), ("c2.xhtml", 1, "Loose")]
    rows = made.sections.where("book_id = 'good'").orderBy("pos").collect()
    assert [(r.title, r.parent_pos, r.location.anchor) for r in rows] == [("Part A", None, "h.partA"), ("Section A1", 0, "h.secA"), ("Part B", None, "h.partB")]
    assert rows[0].text.startswith("Part A\n\nPart A intro") and rows[1].text.startswith("Section A1\n\n") and "Part B" not in rows[1].text
    kept = json.loads(rows[1].structured_json)
    assert [b["type"] for b in kept["annotations"]] == ["heading", "paragraph"] and kept["annotations"][1]["marks"][0]["style"] == "bold"
    tree = json.loads(books.book_json(made.books, made.sections).where("book_id = 'good'").first().json)
    assert list(tree) == ["type", "title", "location", "subsections"] and tree["subsections"][0]["subsections"][0]["title"] == "Section A1"
    assert list(tree["subsections"][0]["location"]) == ["type", "spine_index", "href", "anchor"]


def test_wrapper_gives_its_text_to_the_first_child(library):
    rows = books.extract(library).sections.where("book_id = 'wrapped'").orderBy("pos").collect()
    assert [(r.title, r.parent_pos) for r in rows] == [("Part A", None), ("Part B", None)]
    assert rows[0].text.startswith("Preface words that wrap.\n\nPart A\n\n")
    kept = json.loads(rows[0].structured_json)
    first = kept["annotations"][0]
    assert rows[0].text[first["start"] : first["end"]] == "Part A" and first["type"] == "heading"


def test_offsets_are_utf16_units(spark):
    wrapper = archive(
        "My Book",
        [("c0.xhtml", "x", "<html><body><p>Preface 🦀🦀 words that wrap.</p></body></html>"), ("c1.xhtml", "x", CHAPTER.format(images='<img src="i/1.png"/> 🦀'))],
        [(0, "My book", "c0.xhtml"), (1, "Part A", "c1.xhtml#h.partA"), (1, "Part B", "c1.xhtml#h.partB")],
        {"i/1.png": PNG},
    )
    tables = epub.book_tables(spark.createDataFrame([("b", wrapper)], "path string, content binary"))
    made = books.extract(tables)
    figs = figures.figures(figures.with_bytes(figures.references(tables["chapter_html"], made.sections), tables["images"]))
    rows = figures.with_images(made.sections, figs).orderBy("pos").collect()

    def part(text, block):
        return text.encode("utf-16-le")[2 * block["start"] : 2 * block["end"]].decode("utf-16-le")

    first = json.loads(rows[0].structured_json)["annotations"]
    assert rows[0].text.startswith("Preface 🦀🦀") and [part(rows[0].text, b) for b in first[:2]][0] == "Part A" and part(rows[0].text, first[1]).startswith("Part A intro")
    image = json.loads(rows[1].structured_json)["annotations"][-1]
    assert image["type"] == "image" and image["start"] == len(rows[1].text.encode("utf-16-le")) // 2 == len(rows[1].text) + 1


def test_toc_of_any_depth(spark):
    rows = [("b", p, p if p < 40 else 79 - p, f"t{p}", None) for p in range(80)] + [("c", 0, 5, "x", None), ("c", 1, 9, "y", None), ("c", 2, 7, "z", None)]
    df = spark.createDataFrame(rows, "book_id string, pos long, depth int, title string, href string")
    got = {(r.book_id, r.pos): (r.parent_pos, r.parent_title) for r in toc.with_parents(df).collect()}
    for book, p, depth, _, _ in rows:
        above = [(q, t) for b, q, d, t, _ in rows if b == book and q < p and d < depth]
        assert got[book, p] == (max(above) if above else (None, None))
    assert toc.with_parents(df.limit(0)).count() == 0


def test_placeholders(spark):
    rows = [("b", 0, 0, "Top", None), ("b", 1, 1, "Leaf", "c1.xhtml"), ("b", 2, 0, "Lost", None)]
    entries = spark.createDataFrame(rows, "book_id string, pos long, depth int, title string, href string")
    html = spark.createDataFrame([("b", 0, "c1.xhtml", "One", "<p>words</p>")], "book_id string, pos long, file string, title string, html string")
    chapters = books.chapter_texts(html)
    titles = spark.createDataFrame([("b", "Other")], "book_id string, title string")
    got = books.sections(books.prepared_toc(entries, titles), chapters, html).orderBy("pos").collect()
    assert [(r.title, r.location.spine_index, r.text) for r in got] == [("Top", -1, None), ("Leaf", 0, "words")]


def test_toc_windows(spark):
    rows = [(0, 0, "f#a"), (1, 1, None), (2, 1, "f"), (3, 2, "f#b"), (4, 0, "g#c"), (5, 1, "f#d")]
    df = spark.createDataFrame([("b", p, d, f"t{p}", h) for p, d, h in rows], "book_id string, pos long, depth int, title string, href string")
    got = toc.with_next_fragment(toc.with_parents(toc.with_references(df))).orderBy("pos").collect()
    assert [r.parent_pos for r in got] == [None, 0, 0, 2, None, 4]
    assert [r.next_fragment for r in got] == ["b", None, "b", None, None, None]
    promoted = spark.createDataFrame([("b", 0, 0, "Intro", "x"), ("b", 1, 1, "Part 2: INTRO", "x"), ("b", 2, 0, "  ", "x")], df.schema)
    assert [r.title for r in toc.promoted_titles(promoted).orderBy("pos").collect()] == ["Part 2: INTRO", "Part 2: INTRO", "Untitled"]


SVG = b'<svg xmlns="http://www.w3.org/2000/svg"><image href="a.png"/></svg>'
IMAGES = (
    '<img src="i/1.png"/><img src="i/copy.png"/><img src="data:image/png;base64,iVBORw0KGgo="/><img src="http://x.y/z.png"/>'
    '<img src="../../escape.png"/><img src="C:\\foo.png"/><img src="i/ok.svg"/><img src="i/bad.svg"/><img src="i/sp%20ace.png#f"/><img src="missing.png"/>'
)
FILES = {"i/1.png": PNG + b"1", "i/copy.png": PNG + b"1", "i/ok.svg": SVG, "i/bad.svg": b'<!DOCTYPE svg><svg/>', "i/sp ace.png": PNG + b"2"}


def test_figures(spark, tmp_path):
    tables = epub.book_tables(spark.createDataFrame([("b", make(images=IMAGES, files=FILES))], "path string, content binary"))
    made = books.extract(tables)
    refs = figures.with_bytes(figures.references(tables["chapter_html"], made.sections), tables["images"])
    reasons = {r.dom_index: r.reject_reason for r in refs.collect()}
    assert [i for i, r in sorted(reasons.items()) if r is None] == [0, 1, 2, 6, 8]
    assert reasons[7] == "unsafe SVG" and reasons[9] == "not in the archive" and reasons[4] == "outside of the archive"
    figs = figures.figures(refs).orderBy("dom_index").collect()
    assert figs[0].path == figs[1].path != figs[2].path and [f.section_local_index for f in figs] == [0, 1, 2, 3, 4]
    assert {f.owner_pos for f in figs} == {2} and figs[0].anchor == "c1.xhtml:0"
    kept = figures.with_images(made.sections, figures.figures(refs)).where("pos = 2").first()
    last = json.loads(kept.structured_json)["annotations"][-1]
    assert last["type"] == "image" and last["start"] == last["end"] == len(kept.text) and last["imagePath"] == figs[-1].path
    assert figures.anchor_paths(figures.figures(refs)).count() == 5
    figures.write_images(figures.figures(refs), str(tmp_path / "images"))
    stored = {r.path: bytes(r.bytes) for r in spark.read.parquet(str(tmp_path / "images")).collect()}
    assert len(stored) == 4 and stored[figs[0].path] == PNG + b"1"


def test_media():
    assert resolve("OEBPS/text/c.xhtml", "../i/a.png#x") == ("OEBPS/i/a.png", None) and resolve("c.xhtml", "./a.png") == ("./a.png", None)
    assert resolve("t/c.xhtml", "../../a")[0] is None and resolve("c.xhtml", "a\\b")[0] is None
    assert decode_data_uri("data:image/png;base64,AAA=") == ("image/png", b"\0\0") and decode_data_uri("data:text/plain,a%20b") == ("text/plain", b"a b")
    assert decode_data_uri("data:image/png;base64,A") is None and decode_data_uri("data:x") is None
    assert decode_numeric("&#106;&#x61;&#99999999;") == "ja&#99999999;"
    assert safe_svg(SVG) and not safe_svg(b'<svg><a xlink:href="&#106;avascript:x"/></svg>') and safe_svg(b'<svg><a href="#x"/><a href="data:x"/></svg>')
    assert epub.navigation_href(" a%20b%2Fc.xhtml#x%20y ") == "a b%2Fc.xhtml#x%20y" and epub.navigation_href("  ") is None and epub.decode_path("%zz") == "%zz"


def patched(raw, offset, value, size=2):
    at = raw.rfind(b"PK\x05\x06")
    return raw[: at + offset] + value.to_bytes(size, "little") + raw[at + offset + size :]


def test_guards():
    raw = make()
    entries, declared = check(raw)
    assert entries == 6 and declared > 100
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * 3_000_000)
    at = raw.rfind(b"PK\x05\x06")
    cases = [
        (b"x", Limits(), "End-Of-Central"), (patched(raw, 10, 0xFFFF), Limits(), "ZIP64"), (patched(raw, 12, 0xFFFFFFFF, 4), Limits(), "ZIP64"),
        (raw[:at] + b"PK\x06\x07" + b"\0" * 16 + raw[at:], Limits(), "ZIP64"), (raw, Limits(max_entries=5), "declares 6"),
        (patched(raw, 10, 2), Limits(max_entries=5), "signature scan"), (raw, Limits(max_text_bytes=50), "cumulative"), (bomb.getvalue(), Limits(), "expansion ratio"),
        (patched(raw, 12, 9_000_000, 4), Limits(), "plausible"),
    ]
    for data, limits, message in cases:
        with pytest.raises(GuardError, match=message):
            check(data, limits)


def test_limits_from_env():
    assert Limits.from_env({"EPUB_MAX_ENTRIES": " 7 ", "EPUB_MAX_BYTES": ""}) == Limits(max_entries=7)
    for bad in ("0", "-1", "x"):
        with pytest.raises(ValueError, match="positive integer"):
            Limits.from_env({"EPUB_MAX_BYTES": bad})


def test_archives_from_files_and_streams(spark, tmp_path):
    from foliant.streaming import stream_archives

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(make())
    (tmp_path / "in" / "huge.epub").write_bytes(make() + b"\0" * 50_000)
    limits = Limits(max_bytes=20_000)
    got = {r.book_id.rpartition("/")[2]: r.guard_error for r in epub.read_books(spark, str(tmp_path / "in"), limits)["books"].collect()}
    assert got["a.epub"] is None and "EPUB_MAX_BYTES" in got["huge.epub"]
    query = stream_archives(spark, str(tmp_path / "in"), limits)["toc"].writeStream.format("memory").queryName("toc_stream").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("toc_stream").count() == 4


def test_page_nodes(spark):
    html = '<h1 id="a">One <i>two</i></h1><a name="b" href="/x">link</a><p>p'
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    nodes = pages.page_nodes(rows)
    assert [tuple(r) for r in pages.headings(rows).select("level", "content").collect()] == [(1, "One two")]
    assert [(r.href, r.content) for r in pages.links(rows).collect()] == [("/x", "link")]
    ids = [pages.fragment_node(nodes, F.lit(x)).collect() for x in ("a", "b", "c")]
    assert [len(x) for x in ids] == [1, 1, 0]
    assert {r.tag: r.n for r in pages.block_counts(nodes).collect()} == {"h1": 1, "p": 1}


def test_streamed_pages(spark, tmp_path):
    from foliant.streaming import stream_pages, stream_texts

    spark.createDataFrame([(1, "u/a.html", "<h1>T</h1><p>x")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    query = stream_texts(stream_pages(spark, str(tmp_path / "p"))).writeStream.format("memory").queryName("pages_stream").start()
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("pages_stream").first()) == (1, "T", "Tx", 2)


def test_queries_have_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert struct.calcsize("<HII") == 10
