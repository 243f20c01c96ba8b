"""Sections and annotations on small pages."""

import hashlib
import json

import pytest

from foliant.functions.annotations import blocks_by_words, letters, section_blocks, structured_json
from foliant.functions.dom import parse
from foliant.functions.sections import Extraction, Page, page_text, page_title


def by_words(html, text):
    return structured_json(text, blocks_by_words(Page(html), text))


def section(html, fragment=None, following=None):
    got = Page(html).extract(fragment, following).cleaned()
    return got, section_blocks(got)


PAD = "Some leading padding so we exceed the fifty character minimum. "
STORED = [
    ("<h1>Title One</h1>", "This is some plain text padding so the 50-char minimum trips. Title One. More.", [("heading", 62, 71, [])]),
    (
        "<p>Hello <strong>bold</strong> and <em>italic</em> text.</p>",
        "Padding so the minimum 50-char check passes. Hello bold and italic text. End.",
        [("paragraph", 45, 72, [("emphasis", 51, 55, "bold"), ("emphasis", 60, 66, "italic")])],
    ),
    (
        '<p>Visit <a href="https://example.com">example</a> today and tomorrow.</p>',
        "Padding so the minimum 50-char check passes. Visit example today and tomorrow. End.",
        [("paragraph", 45, 78, [("link", 51, 58, "https://example.com")])],
    ),
    ("<ul><li>Apples</li><li>Bananas</li></ul>", PAD + "Apples Bananas End.", [("paragraph", 63, 69, []), ("paragraph", 70, 77, [])]),
    ("<dl><dt>Term</dt><dd>Its meaning.</dd></dl>", PAD + "Term Its meaning. End.", [("paragraph", 63, 67, []), ("paragraph", 68, 80, [])]),
    ("<script>x</script><p>Visible.</p><style>y</style><p>Also seen.</p>", PAD + "Visible. Also seen.", [("paragraph", 63, 71, []), ("paragraph", 72, 82, [])]),
    ("<blockquote>Quoted.</blockquote>", PAD + "Quoted.", [("paragraph", 63, 70, [])]),
    ("<div><h1>Title</h1><p>Body.</p></div>", PAD + "Title Body.", [("heading", 63, 68, []), ("paragraph", 69, 74, [])]),
]


@pytest.mark.parametrize(("html", "text", "want"), STORED)
def test_by_words(html, text, want):
    got = json.loads(by_words(f"<html><body>{html}</body></html>", text))
    assert got["schemaVersion"] == 1 and got["baseTextHash"] == hashlib.sha256(text.encode()).hexdigest()
    assert [(b["type"], b["start"], b["end"], [(m["type"], m["start"], m["end"], m.get("style") or m.get("url")) for m in b["marks"]]) for b in got["annotations"]] == want


def test_stored_form():
    html = "<html><body><h1>Title One</h1></body></html>"
    want = (
        '{"schemaVersion":1,"baseTextHash":"f8b8459426e3b798deb0062554ed65d3e095ad0601c59a389d9ac568d83e1fe4",'
        '"annotations":[{"type":"heading","start":62,"end":71,"level":1,"marks":[]}]}'
    )
    assert by_words(html, STORED[0][1]) == want
    assert by_words("<p>Short.</p>", "Short text.") is None
    assert by_words("<span>just inline</span>", "Some plain text exceeding the fifty character minimum threshold.") is None


def test_code_and_captions():
    html = (
        '<p>Intro text that is long enough to be annotated here.</p><figure class="code"><figcaption>Listing</figcaption>'
        "<pre>a\tb\n  c</pre></figure><p>Use <code>x</code> and <code>x</code>.</p>"
    )
    got, blocks = section(html)
    told = [(b["type"], got.text[b["start"] : b["end"]], [m["type"] for m in b["marks"]], b.get("preserveLineBreaks")) for b in blocks]
    assert told == [
        ("paragraph", "Intro text that is long enough to be annotated here.", [], None),
        ("paragraph", "Listing", ["emphasis"], None),
        ("paragraph", "a    b\n  c", ["monospace"], True),
        ("paragraph", "Use x and x.", ["monospace", "monospace"], None),
    ]
    first, second = blocks[3]["marks"]
    assert first["end"] <= second["start"]


def test_lists():
    html = (
        "<p>Padding paragraph so that this text is long enough.</p><ol type='a'><li>outer<ul><li>inner <b>bold</b></li></ul>tail</li><li>two</li></ol>"
    )
    got, blocks = section(html)
    items = [(got.text[b["start"] : b["end"]], b["listMarker"], b.get("depth", 0)) for b in blocks if b["type"] == "listItem"]
    assert items == [("outer", "a.", 0), ("inner bold", "•", 1), ("tail", "", 0), ("two", "b.", 0)]
    assert [m["style"] for b in blocks for m in b["marks"]] == ["bold"]
    assert [letters(n, "A") for n in (1, 26, 27, 0)] == ["A", "Z", "AA", ""]


def test_definitions_and_tables():
    html = (
        "<p>Padding paragraph so that this text is long enough.</p><dl><dt>Term</dt><dd>Meaning</dd><dd>more</dd><dt>Alone</dt></dl>"
        "<table><caption>Cap</caption><tr><th>h1</th><th> h  2 </th></tr><tr><td></td><td>v</td></tr></table>"
    )
    got, blocks = section(html)
    told = [(b["type"], got.text[b["start"] : b["end"]]) for b in blocks]
    assert told[1][0] == "definitionItem" and told[1][1].startswith("Term") and told[1][1].endswith("Meaning")
    assert told[2] == ("definitionItem", "Alone") and told[3] == ("paragraph", "Cap")
    assert blocks[4]["tableRows"] == [["h1", "h 2"], ["", "v"]]
    for a, b in zip(blocks, blocks[1:]):
        assert a["end"] <= b["start"]


SECTIONS = (
    '<h1 id="h.1">One</h1><p>First body.</p><div class="note"><h1>Inner</h1></div><h2 id="2a">Two</h2><p>Second.</p>'
    '<h1 id="c:3">Three</h1><p>Third <a name="q&quot;">here</a> and on.</p>'
)


def test_section_bounds():
    page = Page(SECTIONS)
    assert page.extract("h.1", "2a").cleaned().text == "One\n\nFirst body.\n\nInner"
    assert page.extract("h.1", None).cleaned().text.endswith("Second.")
    assert page.extract("2a", None).cleaned().text == "Two\n\nSecond."
    assert page.extract("c:3", None).cleaned().text == "Three\n\nThird here and on."
    assert page.extract(None, "2a").cleaned().text == "One\n\nFirst body.\n\nInner"
    assert page.extract("missing", None).text == "" and page.extract(None, "missing").text == ""
    assert page.extract('q"', None).cleaned().text == "here and on."
    assert page.plain_section("2a", "c:3") == "Two\n\nSecond." and page.plain_section("nope", None) == ""


def test_invalid_ranges():
    doc = parse("<p>x")
    p = doc.body.children[0]
    for preserved, elements in (([(0, 9)], {}), ([(1, 1)], {}), ([(0, 3), (2, 4)], {}), ([(3, 4), (0, 1)], {}), ([(1, 3)], {p: [(0, 2)]}), ([], {p: [(2, 6)]})):
        with pytest.raises(ValueError):
            Extraction("12345", preserved, elements, doc).checked()
    Extraction("12345", [(1, 3)], {p: [(1, 2), (3, 5)]}, doc).checked()


def test_titles_and_text():
    assert page_title("<title>T</title><h1> </h1><h2>Two <i>x</i></h2>") == "Two x"
    assert page_title("<p>none") is None
    assert page_text("<p>a</p><p>b</p><script>no</script>\n  c   d") == "ab\nc\nd"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert page_text(deep) == "x" and Page(deep).extract().cleaned().text == "x"


def test_offsets_count_utf16_units():
    from foliant.functions.cleaning import units

    text = units("\U0001F980 padding so that the text is longer than fifty characters.")
    got = section_blocks(Page(units("<p>\U0001F980 padding so that the text is longer than fifty <b>characters</b>.</p>")).extract().cleaned())
    assert got[0]["end"] == len(text) and got[0]["marks"][0]["end"] == len(text) - 1


def test_plain_blocks_are_not_walked_for_marks(monkeypatch):
    """Marks are looked for where elements are; the result is that of a walk through every block."""
    from foliant.functions import annotations

    html = (
        "<h1>Title of the page</h1><p>Plain words that go on for long enough to be annotated.</p><p>With <b>bold <i>and</i> more</b> and <code>code</code>.</p>"
        "<ul><li>Plain item</li><li>Item <em>told</em> twice<ul><li>Inner</li></ul> after <b>it</b></li></ul><dl><dt>Term</dt><dd>Meaning</dd></dl><p></p>"
    )
    walked, walk = [], annotations.Annotator.marks
    monkeypatch.setattr(annotations.Annotator, "marks", lambda self, node, *more: walked.append(node.tag) or walk(self, node, *more))
    got, few = section(html)[1], len(walked)
    monkeypatch.setattr(annotations, "_plain", lambda node: False)
    assert section(html)[1] == got and few < len(walked) - few
    assert [m["type"] for b in got for m in b["marks"]] == ["emphasis", "emphasis", "monospace", "emphasis", "emphasis"]
