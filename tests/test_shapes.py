"""Pages of one shape, their tree built once, against pages parsed in full."""

import pytest

from foliant import catalog_sheets
from foliant.functions import shapes
from foliant.functions.cleaning import units
from foliant.functions.dom import parse
from foliant.functions.sections import UNSEEN, Page, page_text
from foliant.operators.pages import annotated

#: Pages, and what NAME stands for in each in turn.
SHAPES = [
    (catalog_sheets.SHEET, ["one", "two words", "🦀 crab", "a > b", '"quoted"', "x\ny  z"]),
    ("<p>NAME<b>bold</b> tail</p><pre>NAME</pre>", ["one", "\none", " one", " ", "\n", "", "a\0b", "a &amp; b"]),
    ("NAME<p>first</p>", ["one", " one", "  ", ""]),
    ("<table>NAME<tr><td>x</td></tr>NAME</table>", ["x", " ", "y"]),
    ('<p a="x>NAME</p><p b=">y">NAME</p>', ["one", 'y">z', '"']),
    ("<!-- <b>NAME</b> --><p>NAME</p>", ["one", "x--> "]),
    ("<title>NAME</title><script>NAME</script><textarea>\nNAME</textarea>", ["one", "two", "\n"]),
    ("<p>NAME<!-- c -->NAME", ["one", " ", "< b"]),
]


def tree(doc):
    return [(n.index, n.end, n.tag, n.parent and n.parent.index, n.attrs, n.data, [c.index for c in n.children]) for n in doc.nodes]


@pytest.mark.parametrize("page", range(len(SHAPES)))
def test_equal_to_pages_parsed_in_full(page):
    html, names = SHAPES[page]
    for name in names * 3:
        source = units(html.replace("NAME", name).replace("TYPE", "t " + name))
        kept, full = Page.passing(source), Page(source)
        assert tree(kept.doc) == tree(full.doc)
        assert annotated(kept, None, None, lambda: page_text(source)) == annotated(full, None, None, lambda: page_text(source))


def test_a_shape_is_parsed_once(monkeypatch):
    """The first page of a shape is parsed, the second makes the tree that is kept, no other is parsed at all."""
    parsed = []
    monkeypatch.setattr(shapes, "parse", lambda source: parsed.append(source) or parse(source))
    monkeypatch.setattr(shapes, "_kept", {})
    monkeypatch.setattr(shapes, "_seen", set())
    for i in range(100):
        assert Page.passing(units(catalog_sheets.SHEET.replace("NAME", f"name {i}"))).doc.nodes[6].data == f"name {i}"
    assert len(parsed) == 2


def test_bounds_of_what_is_kept(monkeypatch):
    """Beyond the bounds pages are parsed in full; nothing of them is left out."""
    monkeypatch.setattr(shapes, "_kept", {})
    monkeypatch.setattr(shapes, "_seen", set())
    monkeypatch.setattr(shapes, "MOST_SEEN", 5)
    for _ in range(3):
        for i in range(shapes.MOST_SHAPES + 10):
            source = f"<p>{'<b>x</b>' * i}NAME {i}</p>"
            assert tree(Page.passing(source).doc) == tree(Page(source).doc)
    long = "<p>" + "<i>y</i>" * (shapes.MOST_TAGS + 1) + "</p>"
    for _ in range(3):
        assert tree(shapes.document(long, UNSEEN)[0]) == tree(Page(long).doc)
    assert len(shapes._kept) <= shapes.MOST_SHAPES and len(shapes._seen) <= 5
