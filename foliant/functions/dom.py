"""A tree builder for HTML as browsers read it: implied tags, open formatting carried on, misnested tags, tables.

Only what a document's text and structure need is kept: elements, attributes and text. Trees are built and walked with
explicit stacks, so depth is no limit, and each node knows its place in document order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

from .cleaning import units

_WS = " \t\n\f\r"
#: Tag sets of the HTML standard's parsing rules.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
_HEAD = frozenset("base basefont bgsound link meta title script style noframes template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p section"
    " summary ul pre listing form table hr xmp plaintext li dd dt".split()
)
_SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed"
    " fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input li link listing main"
    " marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script section select source style summary table tbody td"
    " template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
_ROWS = frozenset("tbody thead tfoot".split())

#: Tags that nothing but ``parse``'s short ways need: blocks that close a paragraph and have no rule of their own, and what
#: may stand between a list and its items' tags without closing an item.
_SIMPLE = (_CLOSES_P | HEADINGS) - frozenset("li dd dt form table hr xmp plaintext".split())
_ITEMS = frozenset(("li", "dd", "dt"))
_LISTS = frozenset(("ul", "ol", "dl"))
_ENDED = (_CLOSES_P | HEADINGS) - frozenset(("table", "xmp"))
#: What stands in a plain tag: (whether it is an end, tag).
_PLAIN = {e + t: (bool(e), t) for t in (_SPECIAL | FORMATTING | {"span", "sub", "sup"}) - RAW for e in ("", "/")}

_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*)))?""")
_COMMENT_END = re.compile(r"--!?>")
_SHORT_COMMENT = re.compile(r"<!--(-?>)")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)")


class Node:
    """An element (``tag``) or a text (``tag`` None, ``data``). index, end: its place in document order, and that after
    its last descendant."""

    __slots__ = ("attrs", "children", "data", "end", "index", "parent", "tag")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.index = self.end = -1

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if c.tag)

    def walk(self) -> Iterator[Node]:
        """Itself and its descendants in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        children = self.children
        if len(children) == 1 and children[0].tag is None:
            return children[0].data
        return "".join([n.data for n in self.walk() if n.tag is None])

    def first(self, tags: frozenset[str] | set[str]) -> Node | None:
        """The first descendant with one of the tags."""
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)


class Document:
    """A parsed page: its root, body, and nodes in document order."""

    def __init__(self, root: Node, body: Node | None):
        self.root, self.body = root, body
        self._nodes: list[Node] | None = None

    @property
    def nodes(self) -> list[Node]:
        if self._nodes is None:
            self._number(frozenset())
        return self._nodes

    def _number(self, but: frozenset[str]) -> None:
        """Number the nodes, leaving out the elements of these tags."""
        nodes, stack, thinned, at = [], [self.root], {}, 0
        while stack:
            node = stack.pop()
            if node.tag in but:
                thinned[id(node.parent)] = node.parent
                continue
            nodes.append(node)
            node.index = at
            at += 1
            node.end = at
            if node.children:
                stack += node.children[::-1]
        for node in thinned.values():
            node.children = [c for c in node.children if c.tag not in but]
        for node in reversed(nodes):
            up = node.parent
            if up is not None and up.end < node.end:
                up.end = node.end
        self._nodes = nodes

    def without(self, tags: frozenset[str]) -> Document:
        """Itself, the elements of these tags taken out."""
        self._number(tags)
        return self

    def by_fragment(self, name: str) -> Node | None:
        """The first element whose id is ``name``, else the first whose name attribute is."""
        named = None
        for node in self.nodes:
            if node.tag:
                if node.attrs.get("id") == name:
                    return node
                if named is None and node.attrs.get("name") == name:
                    named = node
        return named


def _decoded(text: str) -> str:
    return units(html.unescape(text)) if "&" in text else units(text)


def _decoded_attribute(text: str) -> str:
    def one(m: re.Match) -> str:
        known = m[0].endswith(";") or m[0][1] == "#" or (m[0][1:] in html.entities.html5 and text[m.end() : m.end() + 1] != "=")
        return html.unescape(m[0]) if known else m[0]

    return units(_REFERENCE.sub(one, text)) if "&" in text else units(text)


def _token(source: str, mark: int) -> tuple[int, list[tuple[str, str, dict[str, str], bool]]]:
    """What the ``<`` at ``mark`` starts: its end, and (kind, name or text, attributes, self-closing) of its tokens; kind is
    'start', 'end' or 'text'. A tag cut off by the end is dropped."""
    n = len(source)
    plain = _PLAIN_TAG.match(source, mark)
    if plain and not (tag := plain[2].lower()) in RAW:
        return plain.end(), [("end" if plain[1] else "start", tag, {}, False)]
    following = source[mark + 1 : mark + 2]
    if source.startswith("<!--", mark):
        stop = _COMMENT_END.search(source, mark + 4)
        short = _SHORT_COMMENT.match(source, mark)
        return short.end() if short else stop.end() if stop else n, []
    if source.startswith("<![CDATA[", mark) and (stop := source.find("]]>", mark)) >= 0:
        return stop + 3, []
    if following in ("!", "?"):
        stop = source.find(">", mark)
        return n if stop < 0 else stop + 1, []
    if name := _NAME.match(source, mark + (2 if following == "/" else 1)):
        attrs: dict[str, str] = {}
        at = name.end()
        while m := _ATTRIBUTE.match(source, at):
            value = next((v for v in m.groups()[1:] if v is not None), "")
            attrs.setdefault(m[1].lower(), _decoded_attribute(value))
            at = m.end()
        stop = source.find(">", at)
        if stop < 0:
            return n, []
        closing = source[at:stop].endswith("/") or source[stop - 1] == "/"
        at = stop + 1
        tag = name[0].lower()
        out = [("end" if following == "/" else "start", tag, attrs, closing)]
        if following != "/" and tag in RAW:
            stop_tag = _raw_end(tag).search(source, at)
            stop = stop_tag.start() if stop_tag else n
            if stop > at:
                raw = source[at:stop]
                out.append(("text", _decoded(raw) if tag in ("title", "textarea") else units(raw), {}, False))
            at = stop
        return at, out
    if following == "/":
        stop = source.find(">", mark)
        return n if stop < 0 else stop + 1, []
    return mark + 1, [("text", "<", {}, False)]


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I)


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.head = Node("head")
        self.root.append(self.head)
        self.body: Node | None = None
        self.stack: list[Node] = [self.root]  # open elements
        self.active: list[Node | None] = []  # formatting elements to carry on; None is a marker
        self.in_head = False
        self.skip_newline = False
        self.foreign = False  # whether svg or math was ever opened
        self.open_p = 0  # paragraphs on the stack, at most

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def open_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.body = Node("body", attrs)
            self.root.append(self.body)
            self.stack = [self.root, self.body]
            self.in_head = False
        elif attrs:
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)

    def place(self, node: Node, misplaced: bool) -> None:
        """Append to the current element, or before the table where the node may not stand inside of one."""
        if misplaced and self.top.tag in _TABLE_PARTS:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                siblings = table.parent.children
                i = next(k for k, c in enumerate(siblings) if c is table)
                if node.tag is None and i and siblings[i - 1].tag is None:
                    siblings[i - 1].data += node.data
                else:
                    node.parent = table.parent
                    siblings.insert(i, node)
                return
        if node.tag is None and self.top.children and self.top.children[-1].tag is None:
            self.top.children[-1].data += node.data
        else:
            self.top.append(node)

    def text(self, data: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            data = data.removeprefix("\n")
        data = data.replace("\0", "")
        if not data:
            return
        if self.body is None:
            if self.in_head:
                self.top.append(Node(None, data=data))
                return
            if not data.strip(_WS):
                return
            self.open_body()
            data = data.lstrip(_WS)
        blank = not data.strip(_WS)
        if not (blank and self.top.tag in _TABLE_PARTS):
            self.carry_on()
        self.place(Node(None, data=data), misplaced=not blank)

    def push(self, tag: str, attrs: dict[str, str], misplaced: bool = True) -> Node:
        node = Node(tag, attrs)
        self.place(node, misplaced)
        self.stack.append(node)
        if tag == "p":
            self.open_p += 1
        elif tag in ("svg", "math"):
            self.foreign = True
        return node

    def in_scope(self, tags: frozenset[str] | set[str], more: frozenset[str] | set[str] = frozenset()) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in _SCOPE or node.tag in more:
                return False
        return False

    def pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 2:
            tag = self.stack.pop().tag
            self.open_p -= tag == "p"
            if tag in tags:
                return

    def imply_ends(self, but: str = "") -> None:
        while len(self.stack) > 2 and self.top.tag in _IMPLIED and self.top.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.open_p and self.in_scope({"p"}, {"button"}):
            self.imply_ends("p")
            self.pop_to({"p"})

    def carry_on(self) -> None:
        """Open again the formatting elements that were closed by the end of something around them."""
        if not self.active or self.active[-1] is None or self.active[-1] is self.top:
            return
        i = len(self.active)
        while i and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.stack):
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.push(old.tag, dict(old.attrs))

    def format(self, node: Node) -> None:
        same = []
        for old in reversed(self.active):
            if old is None:
                break
            if old.tag == node.tag and old.attrs == node.attrs:
                same.append(old)
        if len(same) >= 3:
            self.active = [n for n in self.active if n is not same[-1]]
        self.active.append(node)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def end_formatting(self, tag: str) -> None:
        """Close a formatting element; what it holds of blocks that stay open gets a copy of it (adoption)."""
        if self.top.tag == tag and not any(n is self.top for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            element = None
            for old in reversed(self.active):
                if old is None:
                    break
                if old.tag == tag:
                    element = old
                    break
            if element is None:
                self.end_other(tag)
                return
            at = next((i for i, n in enumerate(self.stack) if n is element), None)
            if at is None:
                self.active = [n for n in self.active if n is not element]
                return
            if any(n.tag in _SCOPE for n in self.stack[at + 1 :]):
                return
            block_at = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in _SPECIAL), None)
            if block_at is None:
                del self.stack[at:]
                self.active = [n for n in self.active if n is not element]
                return
            block, around = self.stack[block_at], self.stack[at - 1]
            bookmark = next(i for i, n in enumerate(self.active) if n is element)
            last, inner = block, 0
            for i in range(block_at - 1, at, -1):
                inner += 1
                node = self.stack[i]
                place = next((k for k, n in enumerate(self.active) if n is node), None)
                if place is not None and inner > 3:
                    del self.active[place]
                    bookmark -= place < bookmark
                    place = None
                if place is None:
                    del self.stack[i]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[place] = self.stack[i] = copy
                if last is block:
                    bookmark = place + 1
                _detach(last)
                copy.append(last)
                last = copy
            _detach(last)
            if around.tag in _TABLE_PARTS:
                kept, self.stack = self.stack, [*self.stack[: self.stack.index(around) + 1]]
                self.place(last, misplaced=True)
                self.stack = kept
            else:
                around.append(last)
            copy = Node(element.tag, dict(element.attrs))
            for child in block.children:
                copy.append(child)
            block.children = []
            block.append(copy)
            old_at = next(i for i, n in enumerate(self.active) if n is element)
            del self.active[old_at]
            self.active.insert(bookmark - (old_at < bookmark), copy)
            self.stack = [n for n in self.stack if n is not element]
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is block) + 1, copy)

    def end_other(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag == tag:
                self.imply_ends(tag)
                del self.stack[i:]
                return
            if self.stack[i].tag in _SPECIAL:
                return

    def to_table_context(self, stops: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 2 and self.top.tag not in stops:
            self.stack.pop()

    def close_cell(self) -> None:
        if self.in_scope({"td", "th"}):
            self.imply_ends()
            self.pop_to({"td", "th"})
            self.clear_to_marker()

    def close_caption(self) -> None:
        if self.in_scope({"caption"}):
            self.imply_ends()
            self.pop_to({"caption"})
            self.clear_to_marker()

    def start_in_table(self, tag: str, attrs: dict[str, str]) -> None:
        if not any(n.tag == "table" for n in self.stack):
            return
        self.close_cell()
        self.close_caption()
        if tag in ("td", "th"):
            self.to_table_context({"tr", "tbody", "thead", "tfoot", "table"})
            if self.top.tag == "table":
                self.push("tbody", {}, False)
            if self.top.tag != "tr":
                self.push("tr", {}, False)
            self.active.append(None)
        elif tag == "tr":
            self.to_table_context(_ROWS | {"table"})
            if self.top.tag == "table":
                self.push("tbody", {}, False)
        else:
            self.to_table_context({"table"})
            if tag == "caption":
                self.active.append(None)
            elif tag == "col":
                self.push("colgroup", {}, False)
        self.push(tag, attrs, False)
        if tag == "col":
            self.stack.pop()

    def start(self, tag: str, attrs: dict[str, str], closing: bool) -> None:
        self.skip_newline = False
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head":
            self.head.attrs.update(attrs)
            return
        if tag == "body":
            self.open_body(attrs)
            return
        if self.body is None:
            if tag in _HEAD or tag == "noscript":
                node = Node(tag, attrs)
                self.head.append(node)
                if tag in RAW:
                    self.stack.append(node)
                    self.in_head = True
                return
            self.open_body()
        if self.foreign and any(n.tag in ("svg", "math") for n in self.stack[2:]) and tag not in _CLOSES_P and tag not in HEADINGS and tag not in FORMATTING - {"a"}:
            self.push(tag, attrs)
            if closing:
                self.stack.pop()
            return
        if tag in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"):
            self.start_in_table(tag, attrs)
            return
        if tag == "image":
            tag = "img"
        if tag in _CLOSES_P or tag in HEADINGS:
            if tag == "li" or tag in ("dd", "dt"):
                closes = {"li"} if tag == "li" else {"dd", "dt"}
                for node in reversed(self.stack[1:]):
                    if node.tag in closes:
                        self.imply_ends(node.tag)
                        self.pop_to({node.tag})
                        break
                    if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                        break
            if tag == "form" and any(n.tag == "form" for n in self.stack):
                return
            self.close_p()
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.stack.pop()
            if tag == "table" and self.top.tag in _TABLE_PARTS:
                self.pop_to({"table"})
            self.push(tag, attrs)
            if tag in VOID:
                self.stack.pop()
            self.skip_newline = tag in ("pre", "listing")
            return
        if tag in FORMATTING:
            if tag == "a":
                for old in reversed(self.active):
                    if old is None:
                        break
                    if old.tag == "a":
                        self.end_formatting("a")
                        self.active = [n for n in self.active if n is not old]
                        self.stack = [n for n in self.stack if n is not old]
                        break
            self.carry_on()
            self.format(self.push(tag, attrs))
            return
        if tag in ("option", "optgroup") and self.top.tag == "option":
            self.stack.pop()
        if tag == "button" and self.in_scope({"button"}):
            self.imply_ends()
            self.pop_to({"button"})
        if tag not in _HEAD and tag not in ("param", "source", "track"):
            self.carry_on()
        self.push(tag, attrs)
        if tag in VOID or (closing and tag in ("svg", "math")):
            self.stack.pop()
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)
        elif tag == "textarea":
            self.skip_newline = True

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if self.body is None:
            if self.in_head and self.top.tag == tag:
                self.stack.pop()
                self.in_head = False
            elif tag in ("br", "p"):
                self.open_body()
                self.end(tag)
            return
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self.in_scope({"p"}, {"button"}):
                self.push("p", {})
            self.imply_ends("p")
            self.pop_to({"p"})
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(HEADINGS)
        elif tag in ("td", "th"):
            if self.in_scope({tag}):
                self.close_cell()
        elif tag == "caption":
            self.close_caption()
        elif tag in _TABLE_PARTS:
            if any(n.tag == tag for n in self.stack[2:]):
                self.close_cell()
                self.close_caption()
                self.pop_to({tag})
        elif tag in ("li", "dd", "dt"):
            if self.in_scope({tag}, {"ol", "ul"} if tag == "li" else frozenset()):
                self.imply_ends(tag)
                self.pop_to({tag})
        elif tag in _CLOSES_P or tag in ("button", "applet", "marquee", "object"):
            if self.in_scope({tag}):
                self.imply_ends()
                self.pop_to({tag})
                if tag in ("applet", "marquee", "object"):
                    self.clear_to_marker()
        else:
            self.end_other(tag)


def _detach(node: Node) -> None:
    if node.parent is not None:
        node.parent.children = [c for c in node.parent.children if c is not node]
        node.parent = None


def parse(source: str) -> Document:
    """The document of a page's source; there always is a body. Plain tags and texts in places where no rule of the builder
    does more than add or close an element are dealt with here, everything else by the builder."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    builder = _Builder()
    at, n, find, plain = 0, len(source), source.find, _PLAIN.get
    while at < n:
        mark = find("<", at)
        if mark != at:
            data = source[at:mark] if mark > 0 else source[at:]
            if "&" in data or not data.isascii():
                data = _decoded(data)
            top = builder.stack[-1]
            last = builder.active[-1] if builder.active else None
            if builder.body is None or builder.skip_newline or top.tag in _TABLE_PARTS or last is not None and last is not top or "\0" in data:
                builder.text(data)
            elif top.children and top.children[-1].tag is None:
                top.children[-1].data += data
            else:
                top.append(Node(None, None, data))
            if mark < 0:
                break
        stop = find(">", mark)
        known = plain(source[mark + 1 : stop]) if stop > 0 else None
        if known is None:
            at, found = _token(source, mark)
            for kind, name, attrs, closing in found:
                if kind == "text":
                    builder.text(name)
                elif kind == "start":
                    builder.start(name, attrs, closing)
                else:
                    builder.end(name)
            continue
        at = stop + 1
        ends, tag = known
        stack = builder.stack
        top = stack[-1]
        on = top.tag
        if builder.body is None:
            builder.end(tag) if ends else builder.start(tag, {}, False)
        elif ends:
            if on != tag:
                builder.end(tag)
            elif tag in _ENDED:
                stack.pop()
                builder.skip_newline = False
                if tag == "p":
                    builder.open_p -= 1
            elif tag in FORMATTING and builder.active and builder.active[-1] is top:
                stack.pop()
                builder.active.pop()
                builder.skip_newline = False
            else:
                builder.end(tag)
        elif not builder.open_p and on not in _TABLE_PARTS and (tag in _SIMPLE and not (tag in HEADINGS and on in HEADINGS) or tag in _ITEMS and on in _LISTS):
            node = Node(tag)
            top.append(node)
            stack.append(node)
            if tag == "p":
                builder.open_p = 1
            builder.skip_newline = tag == "pre" or tag == "listing"
        else:
            builder.start(tag, {}, False)
    builder.open_body()
    return Document(builder.root, builder.body)
