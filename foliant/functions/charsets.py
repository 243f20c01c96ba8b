"""Character classes with the meaning that the document format's own tools give them.

They differ from Java's and Python's: white space includes no-break spaces and the byte-order mark, word boundaries
are ASCII, and a letter is lower-case if it has a single-character capital of its own.
"""

from __future__ import annotations

import sys
from functools import cache

#: White space of a regular expression's \s, and of trimming (which adds NEL).
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
TRIM = SPACE + "\\u0085"
#: TRIM without the line feed, for the inside of a line.
INLINE = TRIM.replace("\\n", "")
#: The characters of TRIM, for str.strip.
TRIM_CHARS = "\t\n\x0b\f\r \u0085\u00A0\u1680\u2028\u2029\u202F\u205F\u3000\uFEFF" + "".join(map(chr, range(0x2000, 0x200B)))
ASCII_SPACE = " \t\n\r"

#: Letters at which a hyphenated line break is mended.
SMALL = "a-ząćęłńóśźż"
LETTER = SMALL + "A-ZĄĆĘŁŃÓŚŹŻ"

#: Private-use glyphs of one publisher's font, and the capitals that they stand for.
GLYPHS = {
    "\uE000\uE003": "C",
    "\uE015": "S",
    "\uE004": "D",
    "\uE005": "E",
    "\uE006": "F",
    "\uE007": "G",
    "\uE008": "H",
    "\uE009": "I",
    "\uE00A": "J",
    "\uE00B": "K",
    "\uE00C": "L",
    "\uE00D": "M",
    "\uE00E": "N",
    "\uE00F": "O",
    "\uE010": "P",
    "\uE011": "Q",
    "\uE012": "R",
    "\uE013": "S",
    "\uE014": "T",
    "\uE016": "U",
    "\uE017": "V",
    "\uE018": "W",
    "\uE019": "X",
    "\uE01A": "Y",
    "\uE01B": "Z",
    "\uE001": "A",
    "\uE002": "B",
}


def is_lower(c: str) -> bool:
    """Whether a character is its own small form and has another, single capital ('ß' has none)."""
    up = c.upper()
    return c.lower() == c and up != c and len(up) == 1


@cache
def lower_class() -> str:
    """Inside of a character class: the characters for which ``is_lower`` holds, as ranges."""
    out, start, last = [], None, None
    for point in range(sys.maxunicode + 1):
        if not 0xD800 <= point <= 0xDFFF and is_lower(chr(point)):
            if last == point - 1 and start is not None:
                last = point
                continue
            if start is not None:
                out.append((start, last))
            start = last = point
    out.append((start, last))
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)
