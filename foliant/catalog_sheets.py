"""Registered queries over composed pages: one sheet of markup for each row of ``part``.

The driver's pages have no ids, lists with markers, code, captions, definitions or tables, so sheets are composed from
the columns of ``part`` by an SQL expression. Their structure being known, SQL can state what extraction has to find:
templates below hold the expected texts, with the elements' places marked as ``{name|...}``; an offset is the sum of the
lengths before it, in UTF-16 units.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table
from .operators import edits, figures, pages
from .plans.rows import spread

COLUMNS = {"NAME": "p_name", "TYPE": "p_type", "BRAND": "p_brand"}

SHEET = (
    '<html><head><title>t</title><script>var a = "<p>";</script></head><body><h1 id="top">NAME</h1>'
    '<p>Made of <b>TYPE</b> and <a href="http://x.org/y">BRAND</a> 🦀 by <code>NAME</code> twice over.</p>'
    '<ul><li>First BRAND</li><li>Second <i>TYPE</i><ol type="a"><li>Inner NAME</li><li>Other</li></ol></li></ul>'
    "<pre>if x:\n\tBRAND</pre>"
    '<figure class="code"><pre>code  TYPE</pre><figcaption>Listing BRAND</figcaption></figure>'
    "<dl><dt>Term BRAND</dt><dd>Meaning TYPE</dd><dt>Lone</dt></dl>"
    "<table><caption>Table BRAND</caption><tr><th>A</th><th>B</th></tr><tr><td>NAME</td><td>TYPE</td></tr></table>"
    '<h2 id="more">More BRAND</h2><p>Closing words of NAME.</p>'
    '<div class="note"><h2>Note BRAND</h2><p>Inside the note.</p></div>'
    '<h2><a name="last"></a>Last BRAND</h2><p>The end.</p></body></html>'
)

_HEAD = "\n\n{h1|NAME}\n\n{p1|Made of {b|TYPE} and {a|BRAND} 🦀 by {code|NAME} twice over.}"
_TABLE = "{caption|Table BRAND}\n\n\n\n\n\n{table|A\n\nB\n\n\n\nNAME\n\nTYPE}"
_LISTS = "\n\n\n\n{li1|First BRAND}\n\n{li2|Second {i|TYPE}}\n\n\n\n{li3|Inner NAME}\n\n{li4|Other}"
_TERMS = "\n\n\n\n{dt1|Term BRAND}\n\n{dd1|Meaning TYPE}\n\n{dt2|Lone}\n\n"
_MORE = "\n\n{h2|More BRAND}\n\n{p2|Closing words of NAME.}\n\n\n\n{h3|Note BRAND}\n\n{p3|Inside the note.}"
_LAST = "\n\n{h4|Last BRAND}\n\n{p4|The end.}"
#: Texts before cleaning: of the whole page, and of its sections. A walk from a fragment makes no break at code and captions,
#: nor at a heading that the fragment's element stands inside of.
_FIRST = _HEAD + _LISTS + "\n\n{pre1|if x:\n    BRAND}\n\n\n\n{pre2|code  TYPE}\n\n{figcaption|Listing BRAND}" + _TERMS + _TABLE
WHOLE = _FIRST + _MORE + _LAST
TOP = _HEAD + _LISTS + "{pre1|if x:\n    BRAND}\n\n{pre2|code  TYPE}{figcaption|Listing BRAND}" + _TERMS + _TABLE
MORE, LAST = _MORE, _LAST.lstrip()


def _cleaned(template: str) -> str:
    """Blocks are one empty line apart, but nothing stands between preserved ranges."""
    return re.sub(r"\n{3,}", "\n\n", template).replace("}\n\n{pre2|", "}{pre2|").replace("}\n\n{figcaption|", "}{figcaption|")


NODES = {"li1": (19, "li"), "li2": (21, "li"), "li3": (26, "li"), "li4": (28, "li"), "pre1": (30, "pre"), "pre2": (33, "pre"), "figcaption": (35, "figcaption"),
         "dt1": (38, "dt"), "dd1": (40, "dd"), "dt2": (42, "dt"), "table": (44, "table"), "caption": (45, "caption")}
PRESERVED = ("pre1", "pre2", "figcaption")
#: (type, place, end of the place if it is another one, fields, marks) of the page's blocks, in order.
BLOCKS = [
    ("heading", "h1", "h1", {"level": 1}, []),
    ("paragraph", "p1", "p1", {}, [("emphasis", "b", "bold"), ("link", "a", "http://x.org/y"), ("monospace", "code", None)]),
    ("listItem", "li1", "li1", {"listMarker": "•"}, []),
    ("listItem", "li2", "li2", {"listMarker": "•"}, [("emphasis", "i", "italic")]),
    ("listItem", "li3", "li3", {"listMarker": "a.", "depth": 1}, []),
    ("listItem", "li4", "li4", {"listMarker": "b.", "depth": 1}, []),
    ("paragraph", "pre1", "pre1", {"preserveLineBreaks": True}, [("monospace", "pre1", None)]),
    ("paragraph", "pre2", "pre2", {"preserveLineBreaks": True}, [("monospace", "pre2", None)]),
    ("paragraph", "figcaption", "figcaption", {}, [("emphasis", "figcaption", "italic")]),
    ("definitionItem", "dt1", "dd1", {"definitionTermEnd": "dt1"}, []),
    ("definitionItem", "dt2", "dt2", {"definitionTermEnd": "dt2"}, []),
    ("paragraph", "caption", "caption", {}, [("emphasis", "caption", "italic")]),
    ("table", "table", "table", {"tableRows": True}, []),
    ("heading", "h2", "h2", {"level": 2}, []),
    ("paragraph", "p2", "p2", {}, []),
    ("heading", "h3", "h3", {"level": 2}, []),
    ("paragraph", "p3", "p3", {}, []),
    ("heading", "h4", "h4", {"level": 2}, []),
    ("paragraph", "p4", "p4", {}, []),
]
TABLE_ROWS = """concat('[["A","B"],["', p_name, '","', p_type, '"]]')"""


def _text(template: str) -> str:
    """The template's text as an SQL expression, its places left out."""
    plain = re.sub(r"\{\w+\||\}", "", template)
    parts = [COLUMNS.get(p) or "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for p in re.split("(NAME|TYPE|BRAND)", plain) if p]
    return "concat(" + ", ".join(f"({p})" if "||" in p else p for p in parts) + ")"


def _places(template: str) -> dict[str, tuple[str, str]]:
    """(start, end) of each marked place as SQL expressions."""
    out, opened, fixed, seen = {}, [], 0, []

    def here() -> str:
        return " + ".join([str(fixed), *(f"length({c})" for c in seen)])

    for token in re.findall(r"\{\w+\||\}|NAME|TYPE|BRAND|[^{}]", template):
        if token in COLUMNS:
            seen.append(COLUMNS[token])
        elif token == "}":
            name, start = opened.pop()
            out[name] = (start, here())
        elif token[0] == "{":
            opened.append((token[1:-1], here()))
        else:
            fixed += len(token.encode("utf-16-le")) // 2
    return out


def _markup(text: str) -> str:
    """A template's markup as an SQL expression that Spark and DuckDB share."""
    parts = [COLUMNS.get(p) or "'" + p + "'" for p in re.split("(NAME|TYPE|BRAND)", text) if p]
    return "concat(" + ", ".join(p.replace("\n", "', chr(10), '").replace("\t", "', chr(9), '") for p in parts) + ")"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", *COLUMNS.values()))
    return parts.select("p_partkey", F.expr(_markup(SHEET)).alias("html"))


def _json_ranges(names: list[str], at: dict[str, tuple[str, str]]) -> str:
    each = [f"""'{{"start":', {at[n][0]}, ',"end":', {at[n][1]}, '}}'""" for n in names]
    return "concat('[', " + ", ',', ".join(each) + ", ']')" if names else "'[]'"


def _json_elements(names: list[str], at: dict[str, tuple[str, str]]) -> str:
    each = [f"""'{{"node_id":{NODES[n][0]},"tag":"{NODES[n][1]}","ranges":', {_json_ranges([n], at)}, '}}'""" for n in names]
    return "concat('[', " + ", ',', ".join(each) + ", ']')" if names else "'[]'"


def _json_block(block: tuple, at: dict[str, tuple[str, str]]) -> str:
    kind, first, last, more, marks = block
    parts = [f"""'{{"type":"{kind}","start":', {at[first][0]}, ',"end":', {at[last][1]}"""]
    for key in ("level", "listMarker", "definitionTermEnd", "tableRows", "preserveLineBreaks", "depth"):
        value = more.get(key)
        if value is not None:
            told = at[value][1] if key == "definitionTermEnd" else TABLE_ROWS if key == "tableRows" else "'true'" if value is True else f"'\"{value}\"'" if key == "listMarker" else f"'{value}'"
            parts.append(f"""',"{key}":', {told}""")
    told = []
    for name, place, extra in marks:
        field = {"emphasis": "style", "link": "url"}.get(name)
        tail = f',"{field}":"{extra}"' if field else ""
        told.append(f"""'{{"type":"{name}","start":', {at[place][0]}, ',"end":', {at[place][1]}, '{tail}}}'""")
    parts.append("""',"marks":[', """ + (", ',', ".join(told) + ", " if told else "") + "']}'")
    return ", ".join(parts)


def _json(template: str, blocks: list[tuple]) -> str:
    at = _places(template)
    body = ", ',', ".join(_json_block(b, at) for b in blocks)
    return f"""concat('{{"schemaVersion":1,"baseTextHash":"', sha256({_text(template)}), '","annotations":[', {body}, ']}}')"""


_CLEAN = _cleaned(WHOLE)


@query("sheet_sections", f"SELECT p_partkey, {_text(_CLEAN)} AS text, {_json(_CLEAN, BLOCKS)} AS structured_json, FALSE AS fallback FROM part")
def sheet_sections(spark, sf_dir):
    """Each sheet as one cleaned and annotated section, its stored annotations byte for byte."""
    return pages.annotated_pages(sheets(spark, sf_dir), "p_partkey")


def _block_rows() -> str:
    at, out = _places(_CLEAN), []
    for i, (kind, first, last, more, _) in enumerate(BLOCKS):
        term = at[more["definitionTermEnd"]][1] if "definitionTermEnd" in more else "NULL"
        out.append(
            f"SELECT p_partkey, {i} AS block_no, '{kind}' AS type, {at[first][0]} AS \"start\", {at[last][1]} AS \"end\", CAST({more.get('level', 'NULL')} AS INTEGER) AS level, "
            + (f"'{more['listMarker']}'" if "listMarker" in more else "CAST(NULL AS VARCHAR)")
            + f" AS \"listMarker\", {term} AS \"definitionTermEnd\", {TABLE_ROWS if 'tableRows' in more else 'NULL'} AS \"tableRows\", "
            f"CAST({more.get('preserveLineBreaks', 'NULL')} AS BOOLEAN) AS \"preserveLineBreaks\", CAST({more.get('depth', 'NULL')} AS INTEGER) AS depth FROM part"
        )
    return " UNION ALL ".join(out)


@query("sheet_blocks", _block_rows())
def sheet_blocks(spark, sf_dir):
    rows = pages.blocks(pages.annotated_pages(sheets(spark, sf_dir), "p_partkey"), "p_partkey")
    return rows.select("p_partkey", "block_no", "type", "start", "end", "level", "listMarker", "definitionTermEnd", F.to_json("tableRows").alias("tableRows"), "preserveLineBreaks", "depth")


def _mark_rows() -> str:
    at, out = _places(_CLEAN), []
    for i, (_, _, _, _, marks) in enumerate(BLOCKS):
        for k, (name, place, extra) in enumerate(marks):
            style, url = (f"'{extra}'" if name == n else "CAST(NULL AS VARCHAR)" for n in ("emphasis", "link"))
            out.append(f"SELECT p_partkey, {i} AS block_no, {k} AS mark_no, '{name}' AS type, {at[place][0]} AS \"start\", {at[place][1]} AS \"end\", {style} AS style, {url} AS url FROM part")
    return " UNION ALL ".join(out)


@query("sheet_marks", _mark_rows())
def sheet_marks(spark, sf_dir):
    rows = pages.blocks(pages.annotated_pages(sheets(spark, sf_dir), "p_partkey"), "p_partkey")
    return pages.marks(rows, "p_partkey")


#: fragment, next fragment, text, places, start and end nodes of the sections that are asked for.
_ASKED = [
    (None, None, WHOLE, True, None, None),
    (None, "more", _FIRST, True, None, 58),
    ("top", "more", TOP, True, 5, 58),
    ("more", "last", MORE, False, 58, 68),
    ("last", None, LAST, False, 68, None),
    ("gone", "more", "", False, None, None),
    (None, "gone", "", False, None, None),
]


def _section_rows() -> str:
    out = []
    for fragment, following, template, recorded, start, end in _ASKED:
        at = _places(template)
        names = list(NODES) if recorded else []
        words = _text(template) if template else "''"
        out.append(
            f"SELECT p_partkey, {repr(fragment) if fragment else 'CAST(NULL AS VARCHAR)'} AS fragment, {repr(following) if following else 'CAST(NULL AS VARCHAR)'} AS following, "
            f"{words} AS text, {_json_ranges(list(PRESERVED) if recorded else [], at)} AS preserved, {_json_elements(names, at)} AS elements, "
            f"CAST({start or 'NULL'} AS INTEGER) AS start_node_id, CAST({end or 'NULL'} AS INTEGER) AS end_node_id FROM part"
        )
    return " UNION ALL ".join(out)


@query("sheet_ranges", _section_rows())
def sheet_ranges(spark, sf_dir):
    """Sections between fragments before cleaning: text, preserved ranges, and ranges of elements."""
    asked = F.array(*(F.struct(F.lit(f).cast("string").alias("fragment"), F.lit(n).cast("string").alias("following")) for f, n, *_ in _ASKED))
    found = pages.page_sections(sheets(spark, sf_dir).withColumn("asked", asked), "p_partkey", "html", "asked").where("error is null")
    return found.select(
        "p_partkey", "fragment", "following", "text", F.to_json("preserved").alias("preserved"), F.to_json("elements").alias("elements"), "start_node_id", "end_node_id",
    )


@query(
    "sheet_fragments",
    "SELECT p_partkey, fragment, node_id FROM part, (VALUES ('top', 5), ('more', 58), ('last', 68)) f(fragment, node_id)",
)
def sheet_fragments(spark, sf_dir):
    """Elements by fragment: an id, else a name; of a fragment that isn't there no row."""
    return pages.fragment_nodes(sheets(spark, sf_dir), ["top", "more", "last", "gone"], "p_partkey")


_VISIBLE = f"regexp_replace({_markup(SHEET)}, '<script>.*?</script>', '', 'g')"


@query(
    "sheet_nodes",
    f"SELECT p_partkey, CAST(len(regexp_extract_all(h, '<[a-z]')) + 1 AS BIGINT) AS n_elements, CAST(len(regexp_extract_all(h, '>[^<]+')) AS BIGINT) AS n_texts, 6 AS deepest, "
    f"CAST(len(regexp_extract_all(h, '<(li|p|td)>')) AS BIGINT) AS n_leaves, regexp_replace(h, '<[^>]*>', '', 'g') AS content FROM (SELECT p_partkey, {_VISIBLE} AS h FROM part) s",
)
def sheet_nodes(spark, sf_dir):
    """Nodes of each sheet, counted; the parser adds a tbody. Texts are those of the sheet in order."""
    nodes = pages.page_nodes(sheets(spark, sf_dir), "p_partkey")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("node_id", "text")))), lambda x: x["text"]), "")
    leaves = F.col("tag").isin("li", "p", "td") & (F.size("attrs") == 0)
    return nodes.groupBy("p_partkey").agg(
        F.sum((F.col("kind") == "element").cast("long")).alias("n_elements"), F.sum((F.col("kind") == "text").cast("long")).alias("n_texts"), F.max("depth").alias("deepest"),
        F.sum(leaves.cast("long")).alias("n_leaves"), words.alias("content"),
    )


_AT = _places(WHOLE)


@query(
    "sheet_element_ranges",
    f"SELECT p_partkey, {_AT['li2'][0]} AS item_start, {_AT['li2'][1]} AS item_end, {_AT['table'][0]} AS table_start, {_AT['table'][1]} AS table_end, 0 AS n_none, "
    f"TRUE AS cuts_code, FALSE AS within_code, FALSE AS before_code FROM part",
)
def sheet_element_ranges(spark, sf_dir):
    """Ranges of an element by its node, and whether ranges cut a preserved one."""
    none = F.lit(None).cast("string")
    rows = sheets(spark, sf_dir).withColumns({"f": none, "n": none})
    found = pages.extracted_sections(rows, "p_partkey", "html", "f", "n")
    item, whole = edits.ranges_of(F.col("elements"), F.lit(21)), edits.single_range_of(F.col("elements"), F.lit(44))
    code = F.element_at("preserved", 1)
    from .functions.text import straddles

    def cuts(start, end):
        return straddles(F.struct(start.alias("start"), end.alias("end")), F.col("preserved"))

    return found.select(
        "p_partkey", item[0]["start"].alias("item_start"), item[0]["end"].alias("item_end"), whole["start"].alias("table_start"), whole["end"].alias("table_end"),
        F.size(edits.ranges_of(F.col("elements"), F.lit(5))).alias("n_none"), cuts(code["start"] - 3, code["start"] + 3).alias("cuts_code"),
        cuts(code["start"] + 1, code["end"]).alias("within_code"), cuts(code["start"] - 3, code["start"]).alias("before_code"),
    )


# --- blocks found by their words alone

_PLAIN = "{h1|NAME}\n\n{p1|Made of {b|TYPE} and {a|BRAND}, long enough for a section.}\n\n{li1|First BRAND}\n\n{q|Quoted words of NAME.}"
_PLAIN_HTML = (
    '<div><h1>NAME</h1></div><section><p>Made of <b>TYPE</b>  and <a href="https://x.org/y">BRAND</a>, long enough for a section.</p></section><script>var NAME</script>'
    "<ul><li>First BRAND</li></ul><blockquote>Quoted words\n of NAME.</blockquote>"
)
_PLAIN_BLOCKS = [
    ("heading", "h1", "h1", {"level": 1}, []),
    ("paragraph", "p1", "p1", {}, [("emphasis", "b", "bold"), ("link", "a", "https://x.org/y")]),
    ("paragraph", "li1", "li1", {}, []),
    ("paragraph", "q", "q", {}, []),
]


@query("blocks_by_words", f"SELECT p_partkey, {_json(_PLAIN, _PLAIN_BLOCKS)} AS structured_json FROM part")
def blocks_by_words(spark, sf_dir):
    """Annotations of a given text by the words of its markup, for texts whose ranges aren't known."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_markup(_PLAIN_HTML)).alias("html"), F.expr(_text(_PLAIN)).alias("text"))
    return pages.annotated_texts(rows, "p_partkey", "html", "text").select("p_partkey", "structured_json")


# --- images in markup

_URI = (
    "CASE p_partkey % 5 WHEN 0 THEN concat('data:image/png;x=y,', replace(p_name, ' ', '%20')) WHEN 1 THEN 'data:image/svg+xml;base64,iVBORw0KGgo=' "
    "WHEN 2 THEN 'data:image/jpeg;base64,A' WHEN 3 THEN 'data:text/plain,%zz' ELSE concat('http://x.org/', p_type) END"
)
_SVG = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('<svg><a href=\"', p_type, '.png\"/></svg>') WHEN 1 THEN '<!DOCTYPE svg><svg/>' WHEN 2 THEN '<svg><a xlink:href=\"&#106;avascript:x\"/></svg>' "
    "WHEN 3 THEN '<svg><image href=\"http://x.org/a.png\"/></svg>' WHEN 4 THEN '<svg><a href=\"#x\"/><a href=\"&#x64;ata:x\"/></svg>' ELSE '<svg><!ENTITY a \"b\"></svg>' END"
)


@query(
    "embedded_images",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' END AS media, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'svg' END AS ext, "
    "CASE p_partkey % 5 WHEN 0 THEN lower(hex(encode(p_name))) WHEN 1 THEN '89504e470d0a1a0a' END AS bytes, p_partkey % 6 IN (0, 4) AS safe FROM part",
)
def embedded_images(spark, sf_dir):
    """Data URIs decoded, malformed ones not; and vector graphics without types, entities or targets outside."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_URI).alias("uri"), F.expr(_SVG).cast("binary").alias("svg"))
    found = figures.data_uris(rows, "p_partkey", "uri").select("p_partkey", "media", "ext", F.lower(F.hex("data")).alias("bytes"))
    return found.join(figures.vector_safety(rows, "p_partkey", "svg"), "p_partkey")


# --- cleaning around preserved ranges

_KEPT = "concat('{keep  me', chr(9), '}')"


@query(
    "cleaned_around",
    "SELECT p_partkey, concat(p_name, ' ', p_type, chr(10), chr(10), '{keep  me    }', p_brand) AS text, length(p_name) + length(p_type) + 3 AS kept_start, "
    "length(p_name) + length(p_type) + 17 AS kept_end, length(p_name) + length(p_type) + length(p_brand) + 18 AS length_in, "
    "length(p_name) + length(p_type) + length(p_brand) + 17 AS length_out, length(p_name) + length(p_type) + length(p_brand) + 17 AS last_end FROM part",
)
def cleaned_around(spark, sf_dir):
    """Texts cleaned on both sides of a range that stays as it is, but for its tab."""
    words = F.expr(f"concat(p_name, '  ', p_type, chr(10), chr(10), chr(10), {_KEPT}, '  ', p_brand)")
    start = (F.length("p_name") + F.length("p_type") + 5).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", words.alias("t"), F.array(F.struct(start.alias("start"), (start + 11).alias("end"))).alias("kept"))
    made = edits.cleaned_around(rows, "p_partkey", "t", "kept")
    last = F.element_at("edits", -1)
    return made.select("p_partkey", "text", F.col("preserved")[0]["start"].alias("kept_start"), F.col("preserved")[0]["end"].alias("kept_end"), "length_in", "length_out", edits.output_end(last).alias("last_end"))
