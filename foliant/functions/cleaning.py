"""Cleaning with an edit script: the Python kernels used where offsets have to follow the text.

Texts are in UTF-16 code units (see ``units``), so that offsets mean what the stored annotations mean by them.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .charsets import ASCII_SPACE, GLYPHS, INLINE, LETTER, SMALL, SPACE, TRIM, TRIM_CHARS, is_lower

Range = tuple[int, int]

_WORDS = re.compile(r"([^ \t\n\r]+)")
_ASTRAL = re.compile("[\U00010000-\U0010FFFF]")
_BROKEN_WORD = re.compile(f"([{LETTER}])-\n([{SMALL}])")
_BROKEN_LETTER = re.compile(f"[{SPACE}]([{LETTER}])\n([{SMALL}]+)")
_BROKEN_ASCII = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z])\n([a-z])")
_SMALL_FIRST = re.compile(f"\n[{SMALL}]")
_NEIGHBOURS = re.compile(r"\n(?<=[^\n]\n)[^\n]")
_BLANKS = re.compile(r"[ \t]+")
_EMPTY_LINES = re.compile(r"\n{3,}")
#: Characters that a line isn't let start or end with; that of no text is among them.
_ENDS = ("", " ", "\t", "\r")
_DROPPED = re.compile("[\uE000-\uF8FF\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]")


def units(text: str) -> str:
    """The text with each character beyond U+FFFF as its two surrogates, so that len() counts UTF-16 units."""
    return text if text.isascii() else _ASTRAL.sub(_pair, text)


def _pair(m: re.Match) -> str:
    rest = ord(m[0]) - 0x10000
    return chr(0xD800 + (rest >> 10)) + chr(0xDC00 + (rest & 0x3FF))


def from_units(text: str) -> str:
    """The opposite of ``units``; lone surrogates become U+FFFD."""
    if text.isascii():
        return text
    try:
        text.encode()  # fails at surrogates, and is faster than looking for them
    except UnicodeEncodeError:
        pass
    else:
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@dataclass
class EditScript:
    """Edits over an input, in order: (op, input start, input end, output start, output length).

    op is 'keep', 'replace' or 'delete'. Insertions have no edit: they leave a gap in the output.
    """

    edits: list[tuple[str, int, int, int, int]]
    length_in: int
    length_out: int
    _starts: list[int] = field(default_factory=list, repr=False)

    def _edit(self, offset: int) -> int:
        if len(self._starts) != len(self.edits):
            self._starts = [e[1] for e in self.edits]
        i = bisect_right(self._starts, offset) - 1
        if i < 0 or offset >= self.edits[i][2]:
            raise LookupError(f"no edit holds offset {offset}")
        return i

    def _check(self, offset: int) -> None:
        if not 0 <= offset <= self.length_in:
            raise IndexError(f"offset {offset} is outside 0..{self.length_in}")

    def map_start(self, offset: int) -> int:
        """Where a range that starts at ``offset`` starts in the output."""
        self._check(offset)
        if offset == self.length_in:
            return self.length_out
        i = self._edit(offset)
        op, start, _, out, _ = self.edits[i]
        if op == "delete":
            return next((e[3] for e in self.edits[i + 1 :] if e[0] != "delete"), self.length_out)
        return out + (offset - start if op == "keep" else 0)

    def map_end(self, offset: int) -> int:
        """Where a range that ends before ``offset`` ends in the output."""
        self._check(offset)
        if offset in (0, self.length_in):
            return self.length_out if offset else 0
        i = self._edit(offset - 1)
        op, start, _, out, size = self.edits[i]
        if op == "delete":
            return next((e[3] + e[4] for e in reversed(self.edits[:i]) if e[0] != "delete"), 0)
        return out + (offset - start if op == "keep" else size)


def identity(length: int) -> EditScript:
    return EditScript([("keep", 0, length, 0, length)] if length else [], length, length)


def _edit(a: str, b: str, at: int, out: int) -> tuple[str, int, int, int, int]:
    return ("keep" if a == b else "replace" if b else "delete", at, at + len(a), out, len(b))


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a.startswith(b):
        return len(b)
    if b.startswith(a):
        return len(a)
    return len(os.path.commonprefix([a, b]))


def diff(a: str, b: str) -> EditScript:
    """Edits from a to b: word by word and gap by gap if both have as many words, else one edit between common ends."""
    if a == b:
        return identity(len(a))
    return EditScript(_edits(a, b, 0, 0), len(a), len(b))


def _edits(a: str, b: str, at: int, out: int) -> list[tuple[str, int, int, int, int]]:
    """The edits of ``diff``, a standing at ``at`` of the input and b at ``out`` of the output."""
    if a == b:
        return [("keep", at, at + len(a), out, len(b))] if a else []
    ours, theirs = _WORDS.split(a), _WORDS.split(b)
    # only the gaps at both ends can be empty
    if len(ours) == len(theirs) > 1 and not (theirs[0] and not ours[0] or theirs[-1] and not ours[-1]):
        edits = []
        add = edits.append
        for x, y in zip(ours, theirs):
            if x == y:
                if x:
                    size = len(x)
                    add(("keep", at, at + size, out, size))
                    at += size
                    out += size
            else:
                end, size = at + len(x), len(y)
                add(("replace" if y else "delete", at, end, out, size))
                at, out = end, out + size
        return edits
    head = _common(a, b)
    tail = _common(a[head:][::-1], b[head:][::-1])
    middle_a, middle_b = a[head : len(a) - tail], b[head : len(b) - tail]
    edits = [("keep", at, at + head, out, head)] if head else []
    if middle_a:
        edits.append(_edit(middle_a, middle_b, at + head, out + head))
    if tail:
        edits.append(("keep", at + len(a) - tail, at + len(a), out + len(b) - tail, tail))
    return edits


def _moves(a: str, b: str, at: int, out: int) -> list[tuple[str, int, int, int, int]]:
    """Edits that move every offset as ``_edits`` does; where only empty lines went, words that stay aren't told apart."""
    if "\n\n\n" not in a or " \n" in a or "\n " in a or "\t" in a or "\r" in a or not b.strip(ASCII_SPACE) or _EMPTY_LINES.sub("\n\n", a) != b:
        return _edits(a, b, at, out)
    edits, last = [], 0
    for gap in _EMPTY_LINES.finditer(a):
        start, end = gap.span()
        size = start - last
        if size:
            edits.append(("keep", at + last, at + start, out, size))
            out += size
        edits.append(("replace", at + start, at + end, out, 2))
        out, last = out + 2, end
    if last < len(a):
        edits.append(("keep", at + last, at + len(a), out, len(a) - last))
    return edits


def plain_spaces(text: str) -> str:
    text = text.replace("\u00A0", " ")
    return text if text.strip(TRIM_CHARS) else ""


def fix_line_breaks(text: str) -> str:
    if "\n" not in text:
        return text.rstrip(TRIM_CHARS)
    broken_within = _SMALL_FIRST.search(text) is not None  # else none of the patterns can be met
    if broken_within:
        text = _BROKEN_WORD.sub(r"\1\2", text)
        text = _BROKEN_LETTER.sub(r" \1\2", text)
    raw = text.split("\n")
    lines = [line and line.rstrip(TRIM_CHARS) for line in raw]
    if not _NEIGHBOURS.search(text):  # empty lines between all others: nothing to mend
        return "\n".join(lines)
    out, i, last = [], 0, len(lines) - 1
    while i <= last:
        line = lines[i]
        if line and i < last and lines[i + 1] and is_lower(line[-1]):
            following = raw[i + 1].lstrip(TRIM_CHARS)
            if is_lower(following[0]):
                line, i = f"{line} {following}", i + 1
        out.append(line)
        i += 1
    text = "\n".join(out)
    if not broken_within:
        return text
    for broken in ("historii\ndla", "oświaty\ni", "ogólnego\ndo", "wiedzy\no"):  # fixed values
        text = text.replace(broken, broken.replace("\n", " "))
    return _BROKEN_ASCII.sub(r"\1\2", text)


def clean(text: str, fix_breaks: bool = True, trim: bool = True) -> tuple[str, EditScript]:
    """The cleaned text, and the edits that lead to it."""
    out = cleaned(text, fix_breaks, trim)
    return out, diff(text, out)


def cleaned(text: str, fix_breaks: bool = True, trim: bool = True) -> str:
    out = text
    if _DROPPED.search(out):  # glyphs are among what is dropped
        for glyphs, capital in GLYPHS.items():
            if glyphs in out:
                out = out.replace(glyphs, capital)
        out = _DROPPED.sub("", out)
    if fix_breaks:
        out = fix_line_breaks(out)
    if "\t" in out or "  " in out:
        out = _BLANKS.sub(" ", out)
    if " \n" in out or "\n " in out or out[:1] in _ENDS or out[-1:] in _ENDS or "\r" in out:
        out = "\n".join([line.strip(ASCII_SPACE) for line in out.split("\n")])
    if "\n\n\n" in out:
        out = _EMPTY_LINES.sub("\n\n", out)
    return plain_spaces(out.strip(ASCII_SPACE) if trim else out)


def preserved_form(text: str) -> str:
    return text.replace("\t", "    ").replace("\r", "")


def clean_around(text: str, preserved: list[Range], moves_only: bool = False) -> tuple[str, EditScript]:
    """Clean what is outside the preserved ranges; what is inside stays, but for tabs and carriage returns. With
    ``moves_only`` the edits need not tell words apart that stay next to each other."""
    between = _moves if moves_only else _edits
    if not preserved:
        out = cleaned(text)
        return out, EditScript(between(text, out, 0, 0), len(text), len(out))
    out, at, size, edits = [], 0, 0, []
    for start, end in [*preserved, (len(text), len(text))]:
        if start > at:
            before = text[at:start]
            part = cleaned(before, trim=False)
            edits += between(before, part, at, size)
            out.append(part)
            size += len(part)
        if end > start:
            part = preserved_form(text[start:end])
            edits.append(_edit(text[start:end], part, start, size))
            out.append(part)
            size += len(part)
        at = end
    return "".join(out), EditScript(edits, len(text), size)


def moved(ranges: list[Range], script: EditScript) -> list[Range]:
    """The ranges in the output; those that became empty are dropped."""
    new = [(script.map_start(a), script.map_end(b)) for a, b in ranges]
    return [r for r in new if r[1] > r[0]]


def clean_whitespace(text: str) -> str:
    chunks = (chunk.strip(TRIM_CHARS) for line in text.split("\n") for chunk in line.strip(TRIM_CHARS).split("  "))
    return "\n".join(c for c in chunks if c)


def clean_extracted(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text))
    lines = [line.strip(ASCII_SPACE) for line in re.sub(r"[ \t]{2,}", " ", text).split("\n")]
    return plain_spaces(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(ASCII_SPACE))


def match_form(text: str) -> str:
    if text.isascii() and text.isprintable() and "  " not in text:  # no white space but single spaces
        return text.strip(" ")
    return re.sub(f"[{SPACE}]+", " ", text).strip(TRIM_CHARS)
