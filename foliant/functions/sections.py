"""Text of a page or of a section of it, with the ranges that code, captions, list items and tables take in it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from .charsets import ASCII_SPACE, TRIM_CHARS
from .cleaning import Range, clean_around, clean_extracted, clean_whitespace, moved, preserved_form, units
from .dom import HEADINGS, Document, Node, parse
from .shapes import document

#: Block elements; note containers by data-type, epub:type and parts of class names.
BLOCKS = frozenset(
    "p div section article aside header footer nav main figure figcaption blockquote pre hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd"
    " table tr th td thead tbody tfoot form fieldset legend address details summary".split()
)
NOTE_TYPES = frozenset("note tip warning caution important sidebar".split())
EPUB_NOTE_TYPES = frozenset("note tip warning sidebar".split())
NOTE_CLASSES = ("note", "tip", "warning", "sidebar", "callout", "admonition")
#: Level taken for a section that starts at no heading.
DEFAULT_LEVEL = 2
UNSEEN = frozenset(("script", "style"))


def level_of(node: Node) -> int | None:
    tag = node.tag or ""
    return int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "0123456789" else None


def in_note(node: Node) -> bool:
    """Whether an ancestor is a note, tip, warning, sidebar or the like."""
    for up in node.ancestors():
        kind, epub = up.attrs.get("data-type", "").lower(), up.attrs.get("epub:type", "").lower()
        name = up.attrs.get("class", "").lower()
        if kind in NOTE_TYPES or epub in EPUB_NOTE_TYPES or up.tag == "aside" or any(part in name for part in NOTE_CLASSES):
            return True
    return False


#: Elements that what is inside of them belongs to.
_OWN = frozenset("pre figcaption li dt dd caption table".split())


@dataclass(slots=True)
class Around:
    """What a node's text belongs to: the nearest of each kind, itself included, or none."""

    pre: Node | None = None
    figcaption: Node | None = None
    item: Node | None = None  # li, unless another block stands between
    term: Node | None = None  # dt or dd, likewise
    caption: Node | None = None  # likewise
    table: Node | None = None  # the outermost, unless in its own caption
    outer_table: Node | None = None
    outer_caption: Node | None = None

    def inside(self, node: Node) -> Around:
        """The same for a child of the node that this is of."""
        tag = node.tag
        if tag is None:
            return self
        block = tag in BLOCKS
        if tag not in _OWN and not (block and (self.item or self.term or self.caption)):
            return self
        table = self.outer_table or (node if tag == "table" else None)
        caption = self.outer_caption or (node if tag == "caption" else None)
        own = caption is not None and caption.parent is table
        return Around(
            node if tag == "pre" else self.pre,
            node if tag == "figcaption" else self.figcaption,
            node if tag == "li" else None if block else self.item,
            node if tag in ("dt", "dd") else None if block else self.term,
            node if tag == "caption" else None if block else self.caption,
            None if own else table,
            table,
            caption,
        )


def surroundings(doc: Document) -> list[Around]:
    """``Around`` of every node of the document."""
    out: list[Around] = []
    for node in doc.nodes:
        around = out[node.parent.index] if node.parent is not None else Around()
        out.append(around if node.tag is None else around.inside(node))
    return out


class _Slices:
    """Ranges of the text written while one element is current. policy: 'all', the 'first', or their 'union'."""

    def __init__(self, policy: str):
        self.policy = policy
        self.found: dict[Node, list[Range]] = {}
        self.current: Node | None = None
        self.opened: int | None = None
        self.solid = False

    def turn(self, node: Node | None, at: int, preserved: list[Range]) -> None:
        """Make ``node`` current; a slice ends where another element takes over."""
        if node is self.current:
            return
        if self.opened is not None and self.solid and at > self.opened:
            self._add((self.opened, at), preserved)
        self.current, self.opened, self.solid = node, None, False

    def wrote(self, at: int, solid: bool) -> None:
        if self.current is not None:
            if self.opened is None:
                self.opened = at
            self.solid |= solid

    def _add(self, new: Range, preserved: list[Range]) -> None:
        ranges = self.found.setdefault(self.current, [])
        if self.policy == "all" or not ranges and self.policy == "first":
            ranges.append(new)
        elif self.policy == "union":
            wide = (min(ranges[0][0], new[0]), max(ranges[0][1], new[1])) if ranges else new
            if not straddles(wide, preserved):
                ranges[:] = [wide]


def straddles(r: Range, preserved: list[Range]) -> bool:
    """Whether the first preserved range that a range overlaps doesn't hold it whole."""
    start, end = r
    for a, b in preserved:
        if b > start:
            return a < end and start < end and not (start >= a and end <= b)
    return False


@dataclass
class Extraction:
    """Text with preserved ranges (code, captions) and the ranges of elements."""

    text: str
    preserved: list[Range]
    elements: dict[Node, list[Range]]
    doc: Document
    start: Node | None = None
    end: Node | None = None

    def checked(self) -> Extraction:
        """Itself; ValueError if a range is out of bounds, or preserved ones overlap, or an element's straddles one."""
        last = 0
        for a, b in self.preserved:
            if not (last <= a < b <= len(self.text)):
                raise ValueError(f"preserved range {a}..{b} is empty, unsorted, overlapping or out of bounds")
            last = b
        for node, ranges in self.elements.items():
            for a, b in ranges:
                if not 0 <= a <= b <= len(self.text):
                    raise ValueError(f"range {a}..{b} of {node.tag} is out of bounds")
                if straddles((a, b), self.preserved):
                    raise ValueError(f"range {a}..{b} of {node.tag} straddles a preserved range")
        return self

    def cleaned(self) -> Extraction:
        text, script = clean_around(self.text, self.preserved, moves_only=True)
        elements = {node: new for node, ranges in self.elements.items() if (new := moved(ranges, script))}
        return Extraction(text, moved(self.preserved, script), elements, self.doc, self.start, self.end).checked()


@dataclass
class Recorder:
    """Takes a walk's text and follows what it belongs to."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    preserved: list[Range] = field(default_factory=list)
    elements: dict[Node, list[Range]] = field(default_factory=dict)
    open: list[tuple[Node, int]] = field(default_factory=list)
    caption: tuple[Node, int] | None = None
    around: Around | None = None

    def __post_init__(self) -> None:
        self.slices = {"item": _Slices("all"), "term": _Slices("first"), "table": _Slices("union"), "caption": _Slices("first")}
        self.current: list[_Slices] = []

    def turn(self, around: Around) -> None:
        if around is not self.around:
            self.around = around
            item, term, table, caption = self.slices.values()
            changed = False
            for slices, node in ((item, around.item), (term, around.term), (table, around.table), (caption, around.caption)):
                if node is not slices.current:
                    slices.turn(node, self.size, self.preserved)
                    changed = True
            if changed:
                self.current = [slices for slices in self.slices.values() if slices.current is not None]

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def write(self, text: str) -> None:
        if text:
            if self.current:
                solid = bool(text.strip(ASCII_SPACE))
                for slices in self.current:
                    slices.wrote(self.size, solid)
            if self.open:
                text = preserved_form(text)
            self.parts.append(text)
            self.size += len(text)

    def mark(self, node: Node) -> None:
        """The break that an element makes before what it holds."""
        if node.tag == "br":
            self.put("\n")
        elif node.tag in BLOCKS and not self.open:
            self.put("\n\n")

    def enter(self, node: Node) -> None:
        if node.tag == "figcaption":
            self.caption = (node, self.size)
        self.open.append((node, self.size))

    def leave(self, node: Node) -> None:
        if node.tag == "figcaption":
            if self.caption is None or self.caption[0] is not node:
                return
            self.caption = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] is node:
                _, start = self.open.pop(i)
                if self.size > start:
                    self.preserved.append((start, self.size))
                    self.elements[node] = [(start, self.size)]
                return

    def done(self, doc: Document, start: Node | None = None, end: Node | None = None) -> Extraction:
        self.turn(Around())
        for slices in self.slices.values():
            self.elements.update({node: ranges for node, ranges in slices.found.items() if ranges})
        return Extraction("".join(self.parts), self.preserved, self.elements, doc, start, end)

    @property
    def text(self) -> str:
        return "".join(self.parts)


_PRESERVING = ("pre", "figcaption")


class Page:
    """A page without scripts and styles, parsed once for all of its sections."""

    def __init__(self, source: str):
        self.doc = parse(source).without(UNSEEN)
        self._around: list[Around] | None = None

    @classmethod
    def passing(cls, source: str) -> Page:
        """A page that is done with before the next one of these is made: pages of one shape share a tree."""
        page = cls.__new__(cls)
        page.doc, noted = document(source, UNSEEN)
        if "around" not in noted:
            noted["around"] = surroundings(page.doc)
        page._around = noted["around"]
        return page

    @property
    def around(self) -> list[Around]:
        if self._around is None:
            self._around = surroundings(self.doc)
        return self._around

    def body_text(self) -> str:
        return self.doc.body.text() if self.doc.body else ""

    def _whole(self, stop: Node | None) -> Recorder:
        """Walk the body, up to ``stop``."""
        out, body, inside = Recorder(), self.doc.body, []
        parts, nodes, arounds = out.parts, self.doc.nodes, self.around
        for i in range(body.index, body.end):
            node, around = nodes[i], arounds[i]
            while inside and inside[-1].end <= i:
                out.leave(inside.pop())
            if node is stop:
                break
            if around is not out.around:
                out.turn(around)
            tag = node.tag
            if tag is None:
                out.write(node.data)
            elif tag in BLOCKS:
                if not out.open:
                    parts.append("\n\n")
                    out.size += 2
                if tag in _PRESERVING:
                    out.enter(node)
                    inside.append(node)
            elif tag == "br":
                out.put("\n")
        while inside:
            out.leave(inside.pop())
        return out

    def _from(self, start: Node, next_fragment: str | None) -> Recorder:
        """Walk on from a section's first element to the next fragment, or to a heading of its level or above."""
        out = Recorder()
        level = level_of(start)
        if level is None and (heading := start.first(HEADINGS)) is not None:
            start, level = heading, level_of(heading)
        passed, level, seen = level is None, DEFAULT_LEVEL if level is None else level, False
        held: dict[str, Node | None] = {"pre": None, "figcaption": None}

        def turn(around: Around) -> None:
            for name, before in held.items():
                now = getattr(around, name)
                if now is not before:
                    if before is not None:
                        out.leave(before)
                    if now is not None:
                        out.enter(now)
                    held[name] = now
            out.turn(around)

        for node in self.doc.nodes[start.index :]:
            turn(self.around[node.index])
            if node.tag is None:
                out.write(node.data)
                seen |= bool(node.data.strip(TRIM_CHARS))
                continue
            if next_fragment is not None and next_fragment in (node.attrs.get("id", ""), node.attrs.get("name")):
                break
            own = level_of(node)
            if own is not None and not in_note(node):
                if passed and own <= level and seen:
                    break
                passed |= own == level
            out.mark(node)
        turn(Around())
        return out

    def extract(self, fragment: str | None = None, next_fragment: str | None = None) -> Extraction:
        """The section from one fragment to the next, not cleaned: the whole body if both are none."""
        start = self.doc.by_fragment(fragment) if fragment is not None else None
        end = self.doc.by_fragment(next_fragment) if next_fragment is not None else None
        if fragment is None:
            out = Recorder() if next_fragment is not None and end is None else self._whole(end)
        elif start is None:
            out, end = Recorder(), None
        else:
            out = self._from(start, next_fragment)
        return out.done(self.doc, start, end).checked()

    def plain_section(self, fragment: str | None, next_fragment: str | None) -> str:
        """A section's text without ranges, for pages whose ranges don't hold."""
        if fragment is None and next_fragment is None:
            return self.body_text()
        start = self.doc.by_fragment(fragment) if fragment is not None else None
        end = self.doc.by_fragment(next_fragment) if next_fragment is not None else None
        if fragment is None:
            return clean_extracted(self._whole(end).text if end is not None else "")
        return clean_extracted(self._from(start, next_fragment).text) if start is not None else ""


def page_text(source: str) -> str:
    """The text of a page's body; blocks aren't set apart, as in the body's own text."""
    return clean_whitespace(Page(units(source)).body_text())


def page_title(source: str) -> str | None:
    """The first h1's text, else the first h2's, h3's or title's; none if all are blank."""
    return _title(parse(units(source)))


def title_and_text(source: str) -> tuple[str | None, str]:
    """``page_title`` and ``page_text`` of a page that is parsed once."""
    doc = parse(units(source))
    title, body = _title(doc), doc.without(UNSEEN).body
    return title, clean_whitespace(body.text() if body else "")


def _title(doc: Document) -> str | None:
    for tag in ("h1", "h2", "h3", "title"):
        node = next((n for n in doc.nodes if n.tag == tag), None)
        if node is not None and (title := node.text().strip(TRIM_CHARS)):
            return title
    return None


def node_rows(doc: Document) -> Iterator[tuple]:
    """(node_id, parent_id, depth, kind, tag, attrs, text) in document order."""
    depth: list[int] = []
    for node in doc.nodes:
        depth.append(depth[node.parent.index] + 1 if node.parent is not None else 0)
        parent = node.parent.index if node.parent is not None else None
        yield node.index, parent, depth[-1], "element" if node.tag else "text", node.tag, node.attrs if node.tag else None, None if node.tag else node.data
