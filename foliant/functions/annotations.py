"""Blocks and marks of a section: what of its text is a heading, list item, table or code, and what is emphasised.

Elements whose ranges the walk recorded keep them; headings and paragraphs are found in the text by their own words.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

from .charsets import ASCII_SPACE, SPACE, TRIM_CHARS
from .cleaning import Range, from_units, match_form
from .dom import Node
from .sections import BLOCKS, Extraction, Page, level_of

#: Texts shorter than this get no annotations.
LEAST_TEXT = 50
#: Tag sets by role; block tags that a section's bounds are lifted to; keys of a block in order.
PARAGRAPHS = frozenset("p li dt dd blockquote pre figcaption".split())
CONTAINERS = frozenset("div section article main aside header footer nav figure details summary form fieldset ul ol dl table tbody thead tfoot tr".split())
BOUNDS = BLOCKS - frozenset("hr form fieldset legend address".split())
CODE = frozenset("code kbd samp var tt".split())
LISTS = frozenset(("ul", "ol"))
BLOCK_KEYS = ("type", "start", "end", "level", "caption", "imagePath", "listMarker", "definitionTermEnd", "tableRows", "preserveLineBreaks", "depth", "marks")

#: Methods of the elements with recorded ranges.
_SPECIAL = {"figcaption": "figcaption", "pre": "code", "ul": "list", "ol": "list", "dl": "definitions", "table": "table"}
_ENCODE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_SPACE = re.compile(f"[{SPACE}]")
_SPACES = re.compile(f"[{SPACE}]+")


def letters(n: int, first: str) -> str:
    """1 as the first letter, 26 as the last, 27 as two of the first."""
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(ord(first) + rest) + out
    return out


def _solid(text: str) -> bool:
    return bool(text.strip(ASCII_SPACE))


def _plain(node: Node) -> bool:
    """Whether a node holds nothing but one text."""
    return len(node.children) == 1 and node.children[0].tag is None


def has_block(node: Node) -> bool:
    return not _plain(node) and any(n.tag in BLOCKS for n in node.walk() if n is not node)


def find(text: str, words: str, start: int) -> int:
    """Place of ``words`` from ``start`` on, as they are or else with white space evened out nearby; -1 if nowhere."""
    while words and start < len(text):
        at = text.find(words, start)
        if at >= 0:
            return at
        at = match_form(text[start : start + 3 * len(words)]).find(words)
        if at >= 0:
            place = start
            for _ in range(at):
                if place >= len(text):
                    break
                run = _SPACES.match(text, place)
                place = run.end() if run else place + 1
            return place
        if len(words) <= 30:
            return -1
        words = words[:30]
    return -1


def extent(text: str, start: int, words: str) -> tuple[int, bool]:
    """How far ``words`` go on in the text from ``start``, white space aside, and whether they were met whole."""
    if text.startswith(words, start):
        return len(words), True
    at, k = start, 0
    while at < len(text) and k < len(words):
        if text[at] == words[k]:
            at, k = at + 1, k + 1
        elif _SPACE.match(text[at]):
            at += 1
        elif _SPACE.match(words[k]):
            k += 1
        else:
            break
    return at - start, k >= len(words)


def trim_range(text: str, start: int, end: int) -> Range:
    part = text[start:end]
    headless = part.lstrip(ASCII_SPACE)
    return (end - len(headless), start + len(part.rstrip(ASCII_SPACE))) if headless else (end, end)


_BLANK_HEAD = re.compile(r"(?:[ \t]*[\n\r])+")


def trim_lines(text: str, start: int, end: int) -> Range:
    """Without empty lines at both ends and spaces at the end; the indentation of the first line stays."""
    part = text[start:end]
    head = _BLANK_HEAD.match(part) if part[:1] in ASCII_SPACE else None
    if head:
        start += head.end()
        part = part[head.end() :]
    return start, start + len(part.rstrip(ASCII_SPACE))


def indented(text: str, at: int, least: int) -> int:
    """The start of the indentation before ``at`` if only that stands before it on its line."""
    start = at
    while start > least and text[start - 1] in " \t":
        start -= 1
    return start if start < at and (start == 0 or text[start - 1] in "\n\r") else at


@dataclass
class _Cursor:
    at: int
    end: int


@dataclass
class _Run:
    """Which slice of a list item a walk for marks is in."""

    wanted: int
    now: int = 0
    seen: bool = False

    def close(self) -> None:
        self.now += self.seen
        self.seen = False


@dataclass
class _Item:
    node: Node
    ranges: list[Range]
    depth: int
    marker: str
    slice: int = 0
    in_run: bool = False


@dataclass
class Annotator:
    """Makes the blocks of one text. elements: recorded ranges, none for pages without; first, last: places in document
    order between which headings and paragraphs are looked for."""

    text: str
    elements: dict[Node, list[Range]] | None = None
    first: int = 0
    last: int = 1 << 60
    at: int = 0
    blocks: list[dict] = field(default_factory=list)

    def add(self, kind: str, start: int, end: int, marks: list[dict] | None = None, **more) -> None:
        self.blocks.append({"type": kind, "start": start, "end": end, **more, "marks": marks or []})
        self.at = end

    def range_of(self, node: Node) -> Range | None:
        return next(iter(self.elements.get(node, ())), None)

    def children(self, node: Node) -> None:
        for child in node.elements():
            self.visit(child)

    def container(self, node: Node) -> None:
        self.children(node)
        if self.blocks:
            self.at = self.blocks[-1]["end"]

    def visit(self, node: Node) -> None:
        tag = node.tag
        if tag in ("script", "style"):
            return
        if self.elements is not None:
            special = _SPECIAL.get(tag)
            if special is not None and getattr(self, special)(node):
                return
            if _code_figure(node):
                self.container(node)
                return
        if self.elements is None or self.first <= node.index < self.last:
            level = level_of(node)
            if level is not None:
                self.by_words(node, "heading", level=level)
                return
            if tag in PARAGRAPHS:
                self.by_words(node, "paragraph")
                return
        if tag in CONTAINERS:
            self.container(node)
        else:
            self.children(node)

    # --- elements with recorded ranges

    def figcaption(self, node: Node) -> bool:
        r = self.range_of(node)
        if r is None or not any(_code_figure(up) for up in node.ancestors()):
            return False
        if r[0] >= self.at:
            self.add("paragraph", *r, [{"type": "emphasis", "start": r[0], "end": r[1], "style": "italic"}])
        return True

    def code(self, node: Node) -> bool:
        r = self.range_of(node)
        if r is None:
            return False
        if r[0] >= self.at:
            self.add("paragraph", *r, [{"type": "monospace", "start": r[0], "end": r[1]}], preserveLineBreaks=True)
        return True

    def list(self, node: Node) -> bool:
        number, depth = 0, 0
        for up in node.ancestors():
            depth += up.tag == "li"
        for child in node.elements():
            if child.tag == "li":
                number += 1
                kind = node.attrs.get("type")
                marker = "•" if node.tag == "ul" else f"{letters(number, kind) if kind in ('a', 'A') else number}."
                item = _Item(child, self.elements.get(child, []), depth, marker)
                for part in child.children:
                    self.item_part(part, item)
        return True

    def item_part(self, node: Node, item: _Item) -> None:
        if node.tag in LISTS or node.tag in BLOCKS:
            item.in_run = False
            self.list(node) if node.tag in LISTS else self.visit(node)
        elif node.tag is not None:
            for child in node.children:
                self.item_part(child, item)
        elif _solid(node.data) and not item.in_run:
            item.in_run = True
            if item.slice < len(item.ranges):
                start, end = item.ranges[item.slice]
                start = max(start, self.at)
                if end > start:
                    start, end = trim_range(self.text, start, end)
                if end > start:
                    marks: list[dict] = []
                    if not _plain(item.node):
                        self.marks(item.node, _Cursor(start, end), marks, False, _Run(item.slice))
                    more = {"depth": item.depth} if item.depth else {}
                    self.add("listItem", start, end, marks, listMarker=item.marker, **more)
                    item.marker = ""
                item.slice += 1

    def definitions(self, node: Node) -> bool:
        term: Range | None = None

        def emit(end: int) -> None:
            if term[0] >= self.at and end > term[0]:
                self.add("definitionItem", term[0], end, definitionTermEnd=term[1])

        for child in node.elements():
            if child.tag == "dt":
                if term is not None:
                    emit(term[1])
                term = self.range_of(child)
                if term is None:
                    self.blocks_in(child)
                elif has_block(child):
                    self.mixed_term(child, term)
                    term = None
            elif child.tag == "dd":
                if term is not None:
                    own = None if has_block(child) else self.range_of(child)
                    emit(own[1] if own else term[1])
                    term = None
                self.blocks_in(child)
        if term is not None:
            emit(term[1])
        return True

    def blocks_in(self, node: Node) -> None:
        for child in node.elements():
            self.visit(child) if child.tag in BLOCKS else self.blocks_in(child)

    def mixed_term(self, node: Node, r: Range) -> None:
        """A term that holds blocks: one item at its first text, the blocks in their places."""
        told = False

        def part(n: Node) -> None:
            nonlocal told
            if n.tag in BLOCKS:
                self.visit(n)
            elif n.tag is not None:
                for child in n.children:
                    part(child)
            elif not told and _solid(n.data):
                told = True
                if r[0] >= self.at and r[1] > r[0]:
                    self.add("definitionItem", *r, definitionTermEnd=r[1])

        for child in node.children:
            part(child)

    def table(self, node: Node) -> bool:
        if any(up.tag == "table" for up in node.ancestors()):
            return True
        caption = next((c for c in node.elements() if c.tag == "caption"), None)
        of_caption = self.range_of(caption) if caption is not None else None
        rows = [[_cell(c) for c in row.elements() if c.tag in ("th", "td")] for row in _rows(node)]
        of_table = self.range_of(node) if rows else None
        parts = [("caption", of_caption), ("table", of_table)]
        if of_caption and of_table and of_table[0] < of_caption[0]:
            parts.reverse()
        for name, r in parts:
            if r is not None and r[1] > r[0] and r[0] >= self.at:
                if name == "table":
                    self.add("table", *r, tableRows=rows)
                else:
                    self.add("paragraph", *r, [{"type": "emphasis", "start": r[0], "end": r[1], "style": "italic"}])
        return True

    # --- elements found by their words

    def by_words(self, node: Node, kind: str, **more) -> None:
        words = match_form(node.text().strip(TRIM_CHARS))
        start = find(self.text, words[:60], self.at) if words else -1
        if start < 0:
            return
        start = indented(self.text, start, self.at)
        size, whole = extent(self.text, start, words)
        if size <= 0:
            return
        end = start + size
        if not whole and len(words) > 60:
            tail = words[-30:]
            again = find(self.text, tail, min(max(end - 90, start + 1), len(self.text)))
            if again >= 0 and (more_size := extent(self.text, again, tail)[0]) > 0:
                end = again + more_size
        end = min(max(end, start + 1), len(self.text))
        start, end = trim_lines(self.text, start, end)
        if end > start:
            marks: list[dict] = []
            if not _plain(node):
                self.marks(node, _Cursor(start, end), marks, False, None)
            self.add(kind, start, end, marks, **more)

    def marks(self, node: Node, cursor: _Cursor, out: list[dict], in_code: bool, run: _Run | None) -> None:
        """Marks of the inline elements below ``node``, nested ones inside of the range of the outer."""
        for child in node.children:
            if child.tag is None:
                if run is not None and not run.seen:
                    run.seen = _solid(child.data)
                continue
            if run is not None and (child.tag in LISTS or child.tag in BLOCKS):
                run.close()
                continue
            code = child.tag in CODE
            mark = None
            if run is None or run.now == run.wanted:
                mark = self.mark(child, cursor, in_code)
            if mark is None:
                self.marks(child, cursor, out, in_code or code, run)
            else:
                out.append(mark)
                if run is not None or not _plain(child):
                    self.marks(child, _Cursor(mark["start"], mark["end"]), out, in_code or code, run)
                cursor.at = mark["end"]

    def mark(self, node: Node, cursor: _Cursor, in_code: bool) -> dict | None:
        if node.tag in ("strong", "b", "em", "i"):
            kind = {"type": "emphasis", "style": "bold" if node.tag in ("strong", "b") else "italic"}
        elif node.tag == "a" and node.attrs.get("href", "").startswith("http"):
            kind = {"type": "link", "url": node.attrs["href"]}
        elif node.tag in CODE and not in_code:
            kind = {"type": "monospace"}
        else:
            return None
        words = match_form(node.text().strip(TRIM_CHARS))
        if not words or cursor.at >= cursor.end:
            return None
        start = find(self.text, words, cursor.at)
        if not 0 <= start < cursor.end:
            return None
        end = start + extent(self.text, start, words)[0]
        if not start < end <= cursor.end:
            return None
        return {"type": kind.pop("type"), "start": start, "end": end, **kind}


def _code_figure(node: Node) -> bool:
    if node.tag not in ("figure", "div"):
        return False
    names = node.attrs.get("class", "").split()
    return ((node.tag == "figure" and "code" in names) or (node.tag == "div" and "highlight" in names)) and node.first({"pre"}) is not None


def _rows(node: Node):
    for child in node.elements():
        if child.tag == "tr":
            yield child
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child)


def _cell(node: Node) -> str:
    text = node.text().strip(TRIM_CHARS)
    return text if text.isascii() and text.isprintable() and "  " not in text else _SPACES.sub(" ", text)


def _bound(marker: Node, body: Node) -> int:
    """Place of a section's marker, lifted to the block that it stands in."""
    node = marker
    while node is not body and node.tag not in BOUNDS and node.parent is not None and node.parent is not body:
        node = node.parent
    return node.index


def section_blocks(section: Extraction) -> list[dict]:
    """Blocks of a cleaned section; none for short texts."""
    body = section.doc.body
    if len(section.text.strip(TRIM_CHARS)) < LEAST_TEXT or body is None:
        return []
    first = _bound(section.start, body) if section.start is not None else body.index
    last = _bound(section.end, body) if section.end is not None else body.end
    out = Annotator(section.text, section.elements, first, last)
    out.children(body)
    return out.blocks


def blocks_by_words(page: Page, text: str) -> list[dict]:
    """Blocks of a text by the words of a page alone."""
    if len(text.strip(TRIM_CHARS)) < LEAST_TEXT or page.doc.body is None:
        return []
    out = Annotator(text)
    out.children(page.doc.body)
    return out.blocks


@lru_cache(1024)
def _in_order(keys: tuple[str, ...]) -> bool:
    """Whether keys are those of a block, as they are ordered."""
    return list(keys) == [k for k in BLOCK_KEYS if k in keys]


def structured_json(text: str, blocks: list[dict]) -> str | None:
    """The stored form: version, hash of the text, and blocks with their keys in order; none without blocks."""
    if not blocks:
        return None
    ordered = [b if _in_order(tuple(b)) and None not in b.values() else {k: b[k] for k in BLOCK_KEYS if b.get(k) is not None} for b in blocks]
    content = {"schemaVersion": 1, "baseTextHash": hashlib.sha256(from_units(text).encode()).hexdigest(), "annotations": ordered}
    return from_units(_ENCODE(content))
