"""Pages of one shape, their tree built once.

Much of a corpus comes from few templates: pages whose tags are the same to the letter and whose texts alone differ. What
tree the builder makes of a page depends on its tags and, of each text, on no more than whether it is blank and starts with
white space. So a tree is kept for each shape that was met before, and a further page of that shape has its texts put
into it. Every text of a page is read; whatever doesn't fit this is parsed in full.
"""

from __future__ import annotations

import re

from .dom import Document, Node, parse

#: Bounds of memory, not of what is read: shapes kept, shapes remembered as met once, tags and characters of a page that is
#: looked up.
MOST_SHAPES = 32
MOST_SEEN = 100_000
MOST_TAGS = 1_000
MOST_CHARS = 200_000

_ATTRIBUTES = r"""(?:\s+[A-Za-z_:][A-Za-z0-9_:.-]*(?:="[^"<>]*"|='[^'<>]*')?)*\s*"""
_RAW = "|".join(rf"<(?i:{tag}){_ATTRIBUTES}>(?s:.*?)</(?i:{tag})\s*>" for tag in ("script", "style"))
_PIECES = re.compile(rf"({_RAW}|<[^>]*>)")
#: Tags that end at their first '>' whatever follows.
_SAFE = re.compile(rf"{_RAW}|</?[A-Za-z][A-Za-z0-9:-]*{_ATTRIBUTES}/?>|<!(?!--|\[CDATA\[)[^<>]*>")
_BLANK = " \t\n\f\r"

#: Shapes with the trees kept for them (none: always parsed in full), and hashes of those met once. One of each to a worker.
_kept: dict[tuple, tuple[Document, list[tuple[Node, int]], dict] | None] = {}
_seen: set[int] = set()


def _kind(text: str) -> str:
    """What of a text matters to the tree: none, its first character if that is white space, and whether it is blank."""
    if not text:
        return ""
    if text[0] not in _BLANK:
        return "t"
    return ("n" if text[0] == "\n" else "s") + ("" if text.strip(_BLANK) else "b")


def split(source: str) -> tuple[list[str], tuple] | None:
    """(texts before, between and after the tags, shape) of a page; none if its texts hold what the tree depends on."""
    if len(source) > MOST_CHARS or "\0" in source or "\r" in source:
        return None
    pieces = _PIECES.split(source)
    texts, tags = pieces[::2], pieces[1::2]
    if len(tags) > MOST_TAGS or "<" in texts[-1] or "&" in source and any("&" in text for text in texts):
        return None
    return texts, (*tags, *["t" if text > "!" else _kind(text) for text in texts])


def _tree(tags: tuple[str, ...], kinds: tuple[str, ...], but: frozenset[str]) -> tuple[Document, list[tuple[Node, int]], dict] | None:
    """The tree of a shape, found with texts that are known again; none unless each is a node of its own, or blank and left out."""
    if not all(_SAFE.fullmatch(tag) for tag in tags):
        return None
    lead = {"n": "\n", "s": " "}
    told = [kind and (lead.get(kind[0], "") + (" " * (i + 1) if kind[1:] else f"t{i}.")) for i, kind in enumerate(kinds)]
    doc = parse("".join(text + tag for text, tag in zip(told, (*tags, "")))).without(but)
    places = {text: i for i, text in enumerate(told) if text}
    holes = [(node, places.pop(node.data, -1)) for node in doc.nodes if node.tag is None]
    if any(i < 0 for _, i in holes) or any(not kinds[i][1:] for i in places.values()):
        return None
    return doc, holes, {}


def document(source: str, but: frozenset[str]) -> tuple[Document, dict]:
    """The tree of a page in UTF-16 units without the elements of these tags, and what was noted for its shape. The tree is
    the caller's until the next call only, and not to be changed."""
    found = split(source)
    if found is None:
        return parse(source).without(but), {}
    texts, shape = found
    key = (but, shape)
    if key not in _kept:
        told = hash(key)
        if told not in _seen:
            if len(_seen) >= MOST_SEEN:
                _seen.clear()
            _seen.add(told)
            return parse(source).without(but), {}
        n = len(texts) - 1
        if len(_kept) >= MOST_SHAPES:
            del _kept[next(iter(_kept))]
        _kept[key] = _tree(shape[:n], shape[n:], but)
    kept = _kept[key]
    if kept is None:
        return parse(source).without(but), {}
    doc, holes, noted = kept
    for node, i in holes:
        node.data = texts[i]
    return doc, noted
