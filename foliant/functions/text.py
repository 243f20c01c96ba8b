"""Text cleaning and title parsing as Column expressions (no Python on the executors).

Patterns with a run before a look-ahead start a run only at its first character and keep it whole, so that they are
linear in runs of any length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charsets import GLYPHS, INLINE, LETTER, SMALL, SPACE, TRIM, lower_class

_KEYWORDS = "Part|Część|Rozdział|Guideline|Chapter|Section"  # fixed value: words that number a part


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return _sub(c, f"\\A[{TRIM}]++|(?<![{TRIM}])[{TRIM}]++\\z", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, the unit of stored offsets."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def trimmed_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r"))


def _no_break_spaces(c: Column) -> Column:
    """No-break spaces made plain; a text of nothing but white space becomes empty."""
    plain = F.replace(c, F.lit("\u00A0"), F.lit(" "))
    return F.when(plain.rlike(f"[^{TRIM}]"), plain).otherwise(F.when(c.isNotNull(), ""))


def _trimmed_lines(c: Column) -> Column:
    return _sub(_sub(c, r"(?:\A|(?<=\n))[ \t\r]++", ""), r"(?<![ \t\r])[ \t\r]++(?=\n|\z)", "")


def normalize_whitespace(c: Column) -> Column:
    """One space for runs of spaces and tabs, lines trimmed, at most one empty line in a row, edges trimmed."""
    lines = _sub(_trimmed_lines(_sub(c, r"[ \t]+", " ")), r"\n{3,}", "\n\n")
    return _no_break_spaces(trimmed_ascii(lines))


def fix_line_breaks(c: Column) -> Column:
    """Mend words and sentences that a page layout broke over lines.

    Lines are joined in pairs: a line that ends in a small letter takes in the next if that begins with one, and the
    joined line takes in no more. A mark (U+0001) keeps joined lines from being trimmed on the right as others are.
    """
    low = lower_class()
    c = F.replace(c, F.lit("\x01"), F.lit(""))
    c = _sub(c, f"([{LETTER}])-\\n([{SMALL}])", "$1$2")
    c = _sub(c, f"[{SPACE}]([{LETTER}])\\n([{SMALL}]+)", " $1$2")
    # The look-ahead is cheap where no line ends and starts no run of spaces twice; only then is the large class tried.
    c = _sub(c, f"(?=[^{INLINE}\\n][{INLINE}]*+\\n)([{low}])[{INLINE}]*+\\n[{INLINE}]*+([{low}][^\\n]*+)", "$1 $2\x01")
    c = F.replace(_sub(c, f"(?<![{INLINE}])[{INLINE}]++(?=\\n|\\z)", ""), F.lit("\x01"), F.lit(""))
    for broken in ("historii\ndla", "oświaty\ni", "ogólnego\ndo", "wiedzy\no"):  # fixed values
        c = F.replace(c, F.lit(broken), F.lit(broken.replace("\n", " ")))
    return _sub(c, r"(?<![A-Za-z0-9_])([A-Za-z])\n([a-z])", "$1$2")


def clean_text(c: Column, fix_breaks: bool = True) -> Column:
    """Glyphs mapped, private-use and control characters dropped, line breaks mended, white space normalised."""
    for glyphs, capital in GLYPHS.items():
        if len(glyphs) > 1:
            c = F.replace(c, F.lit(glyphs), F.lit(capital))
    single = {k: v for k, v in GLYPHS.items() if len(k) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    c = _sub(c, r"[\uE000-\uF8FF\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return normalize_whitespace(fix_line_breaks(c) if fix_breaks else c)


def clean_whitespace(c: Column) -> Column:
    """Chunks between line feeds or double spaces, trimmed; those that aren't empty, one a line."""
    return trimmed(_sub(c, f"(?<![{TRIM}])(?=[{TRIM}]*?(?:\\n| {{2}}))[{TRIM}]++", "\n"))


def clean_extracted_text(c: Column) -> Column:
    """White space of text taken from markup: lines trimmed, single spaces, at most one empty line in a row."""
    c = _sub(_sub(_sub(c, r"(?:\G|(?<![ \t]))[ \t]*+\n[ \t]*+", "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}+", " ")
    c = trimmed_ascii(_sub(_trimmed_lines(c), r"\n{3,}", "\n\n"))
    return _no_break_spaces(c)


def preserved_text(c: Column) -> Column:
    """Tabs as four spaces, carriage returns dropped."""
    return F.replace(F.replace(c, F.lit("\t"), F.lit("    ")), F.lit("\r"), F.lit(""))


def match_form(c: Column) -> Column:
    """White space runs as one space, edges trimmed."""
    return trimmed(_sub(c, f"[{SPACE}]+", " "))


def normalize_title(c: Column) -> Column:
    return F.lower(_sub(trimmed(F.coalesce(c, F.lit(""))), f"[{SPACE}]+", " "))


def has_ascii_content(c: Column) -> Column:
    return c.rlike(r"[^ \t\n\r]")


# --- titles and numbers


def strip_numeric_prefix(c: Column) -> Column:
    pattern = f"\\A[{SPACE}]*[0-9]+(?:\\.[0-9]+)*[{SPACE}]+([^\\n\\r\\u2028\\u2029]*)\\z"
    return trimmed(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c))


def parse_major_minor(c: Column) -> Column:
    """Struct (major, minor) of the numbers that the text begins with; null where there are none."""
    pattern = f"\\A[{SPACE}]*([0-9]+)(?:\\.([0-9]+))?"

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("bigint")

    return F.struct(group(1).alias("major"), group(2).alias("minor"))


def to_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; other numbers raise an error."""
    digits = [("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M"), ("M", "", "")]

    def forms(one: str, five: str, ten: str) -> Column:
        return F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]))

    parts = [F.element_at(forms(*d), (F.floor(n / 10**i) % 10 + 1).cast("int")) for i, d in enumerate(digits)]
    bad = F.raise_error(F.concat(F.lit("number must be between 1 and 3999, got "), n.cast("string"))).cast("string")
    return F.when(n.isNull(), F.lit(None).cast("string")).when(n.between(1, 3999), F.concat(*reversed(parts))).otherwise(bad)


def from_roman(c: Column) -> Column:
    """Value of a Roman numeral, read leniently from the right; null if a character isn't one of them or none is there."""
    up = F.upper(c)
    values = F.transform(F.split(F.reverse(up), ""), lambda x: F.element_at(F.array(*map(F.lit, (1, 5, 10, 50, 100, 500, 1000))), F.greatest(F.instr(F.lit("IVXLCDM"), x), F.lit(1))))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(
        values, zero, lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), v.alias("last")), lambda s: s["sum"]
    )
    return F.when(up.rlike(r"\A[IVXLCDM]+\z"), F.when(total > 0, total))


def base26(n: Column, lower: bool = True) -> Column:
    """1 as a, 26 as z, 27 as aa; empty below 1."""
    first = ord("a" if lower else "A")

    def step(s: Column, _: Column) -> Column:
        v = s["v"] - 1
        more = s["v"] > 0
        letter = F.char((F.lit(first) + F.pmod(v, F.lit(26))).cast("int"))
        return F.struct(
            F.when(more, F.floor(v / 26)).otherwise(F.lit(0)).cast("bigint").alias("v"), F.when(more, F.concat(letter, s["out"])).otherwise(s["out"]).alias("out")
        )

    start = F.struct(F.greatest(n.cast("bigint"), F.lit(0)).alias("v"), F.lit("").alias("out"))
    return F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"]))


def list_marker(kind: Column, counter: Column) -> Column:
    """Marker of an ordered list's item: letters for types a and A, else the number."""
    return F.concat(F.when(kind == "a", base26(counter)).when(kind == "A", base26(counter, lower=False)).otherwise(counter.cast("string")), F.lit("."))


def part_number(c: Column) -> Column:
    """The number that a title gives its part, capitals for Roman ones; null if none."""
    patterns = [
        f"(?iu)\\A(?:{_KEYWORDS})[{SPACE}]+([IVXLCDM]+|[0-9]+)(?:[:\\-–—]|\\.[{SPACE}]|[{SPACE}]|\\z)",
        f"(?iu)\\A([IVXLCDM]+)\\.[{SPACE}]",
        f"\\A([0-9]+)\\.[{SPACE}]+",
        f"\\A([0-9]+)[{SPACE}]+",
    ]
    return F.coalesce(*(F.when(c.rlike(p), F.upper(F.regexp_extract(c, p, 1))) for p in patterns))


def strip_part_prefix(c: Column) -> Column:
    """A title without what numbers its part; the title itself, trimmed, where nothing would be left."""
    rest = "([^\\n\\r\\u2028\\u2029]*)\\z"
    patterns = [
        f"(?iu)\\A(?:{_KEYWORDS})[{SPACE}]+[IVXLCDM0-9]+[:\\-–—.]?[{SPACE}]*{rest}",
        f"(?iu)\\A[IVXLCDM]+\\.[{SPACE}]+{rest}",
        f"\\A[0-9]+\\.[{SPACE}]+{rest}",
        f"\\A[0-9]+[{SPACE}]+{rest}",
    ]
    return F.coalesce(*(F.when(c.rlike(p) & (F.regexp_extract(c, p, 1) != ""), trimmed(F.regexp_extract(c, p, 1))) for p in patterns), trimmed(c))


# --- references


def href_file(c: Column) -> Column:
    return F.get(F.split(c, "#", -1), F.lit(0))


def href_fragment(c: Column) -> Column:
    """What stands between the first and the second '#'; null without one."""
    return F.get(F.split(c, "#", -1), F.lit(1))


def strip_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def base_name(c: Column) -> Column:
    """Last path segment up to its first dot."""
    return F.substring_index(F.substring_index(c, "/", -1), ".", 1)


def is_html_file(c: Column) -> Column:
    return F.lower(c).rlike(r"\.(?:x?html|htm)\z")


def heading_level(tag: Column) -> Column:
    """Level of a heading's tag name; null for other tags."""
    return F.nullif(F.regexp_extract(F.lower(tag), r"\Ah([0-9])\z", 1), F.lit("")).cast("int")


def extension_of_mime(c: Column) -> Column:
    m = F.lower(c)
    return (
        F.when(m.startswith("image/png"), "png")
        .when(m.startswith("image/jpeg") | m.startswith("image/jpg"), "jpg")
        .when(m.startswith("image/gif"), "gif")
        .when(m.startswith("image/webp"), "webp")
        .when(m.startswith("image/svg"), "svg")
    )


def extension_of_path(c: Column) -> Column:
    ext = F.regexp_extract(F.lower(F.substring_index(c, "/", -1)), r"[^.](\.[a-z]+)\z", 1)
    return F.when(ext.isin(".png", ".gif", ".webp", ".svg"), F.substring(ext, 2, 9)).when(ext.isin(".jpg", ".jpeg"), F.lit("jpg"))


# --- ranges: structs (start, end), half-open


def range_contains(r: Column, offset: Column) -> Column:
    return (offset >= r["start"]) & (offset < r["end"])


def straddles(r: Column, preserved: Column) -> Column:
    """Whether a range overlaps a preserved one without lying inside it."""
    return F.exists(preserved, lambda p: (p["start"] < r["end"]) & (r["start"] < p["end"]) & ~((r["start"] >= p["start"]) & (r["end"] <= p["end"])))


def valid_preserved(ranges: Column, length: Column) -> Column:
    """Whether ranges are in bounds, not empty, sorted and disjoint."""
    alone = F.forall(ranges, lambda r: (r["start"] >= 0) & (r["end"] > r["start"]) & (r["end"] <= length))
    pairs = F.zip_with(F.slice(ranges, 1, F.greatest(F.size(ranges) - 1, F.lit(0))), F.slice(ranges, 2, F.greatest(F.size(ranges), F.lit(1))), lambda a, b: a["end"] <= b["start"])
    return alone & F.forall(pairs, lambda ok: ok)
