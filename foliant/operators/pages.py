"""Pages: text, title, nodes, and annotated text of single HTML documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.annotations import blocks_by_words, section_blocks, structured_json
from ..functions.cleaning import from_units, units
from ..functions.dom import parse
from ..functions.sections import BLOCKS, UNSEEN, Page, node_rows, page_text, title_and_text
from ..plans.rows import map_rows

MARK = "struct<type:string,start:int,end:int,style:string,url:string>"
BLOCK = (
    "struct<type:string,start:int,end:int,level:int,caption:string,imagePath:string,listMarker:string,definitionTermEnd:int,"
    f"tableRows:array<array<string>>,preserveLineBreaks:boolean,depth:int,marks:array<{MARK}>>"
)
CONTENT = f"struct<schemaVersion:int,baseTextHash:string,annotations:array<{BLOCK}>>"


def _typed(df: DataFrame, id_col: str) -> str:
    return f"{id_col} {dict(df.dtypes)[id_col]}"


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", name_col: str = "url") -> DataFrame:
    """id, title, text, n_chars of each page; a page without a title takes the base of its name."""

    def kernel(page_id, html, base):
        title, words = title_and_text(html or "")
        yield page_id, from_units(title) if title else base or "", from_units(words)

    rows = pages.select(id_col, html_col, text.base_name(F.col(name_col)).alias("base"))
    return map_rows(rows, kernel, f"{_typed(pages, id_col)}, title string, text string").withColumn("n_chars", F.length("text").cast("long"))


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every node in document order: id, node_id, parent_id, end_id (the place after its last descendant), depth, kind,
    tag, attrs, text. Ranges of node_id take the place of subtrees."""

    def kernel(page_id, html):
        doc = parse(units(html or "")).without(UNSEEN)
        for node, (node_id, parent, depth, kind, tag, attrs, data) in zip(doc.nodes, node_rows(doc)):
            yield page_id, node_id, parent, node.end, depth, kind, tag, None if attrs is None else list(attrs.items()), data and from_units(data)

    columns = "node_id int, parent_id int, end_id int, depth int, kind string, tag string, attrs map<string,string>, text string"
    return map_rows(pages.select(id_col, html_col), kernel, f"{_typed(pages, id_col)}, {columns}")


def fragment_node(nodes: DataFrame, fragment: Column, id_col: str = "page_id") -> DataFrame:
    """id, node_id of the element that a fragment names: the first with that id, else the first with that name."""
    rank = F.when(F.col("attrs")["id"] == fragment, 0).when(F.col("attrs")["name"] == fragment, 1)
    best = F.min(F.struct(rank.alias("rank"), F.col("node_id").alias("node_id")))
    return nodes.where(rank.isNotNull()).groupBy(id_col).agg(best["node_id"].alias("node_id"))


def fragment_nodes(pages: DataFrame, fragments: list[str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, fragment, node_id: ``fragment_node`` of several fragments, in the parser's pass: no exchange."""

    def kernel(page_id, html):
        doc = parse(units(html or "")).without(UNSEEN)
        for name in fragments:
            node = doc.by_fragment(units(name))
            if node is not None:
                yield page_id, name, node.index

    return map_rows(pages.select(id_col, html_col), kernel, f"{_typed(pages, id_col)}, fragment string, node_id int")


def element_texts(pages: DataFrame, *tags: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, node_id, tag, attrs, content of the elements with these tags, in the parser's pass: no exchange."""

    def kernel(page_id, html):
        doc = parse(units(html or "")).without(UNSEEN)
        for node in doc.nodes:
            if node.tag in tags:
                yield page_id, node.index, node.tag, list(node.attrs.items()), from_units(node.text())

    columns = "node_id int, tag string, attrs map<string,string>, content string"
    return map_rows(pages.select(id_col, html_col), kernel, f"{_typed(pages, id_col)}, {columns}")


def headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, node_id, level, content of headings."""
    found = element_texts(pages, *(f"h{i}" for i in range(10)), id_col=id_col, html_col=html_col)
    return found.select(id_col, "node_id", text.heading_level(F.col("tag")).alias("level"), "content")


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, node_id, href, content of anchors with a target."""
    found = element_texts(pages, "a", id_col=id_col, html_col=html_col).where(F.col("attrs")["href"].isNotNull())
    return found.select(id_col, "node_id", F.col("attrs")["href"].alias("href"), "content")


def block_counts(nodes: DataFrame) -> DataFrame:
    """tag, n: block elements by tag."""
    return nodes.where(F.col("tag").isin(*sorted(BLOCKS))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def annotated(page: Page, fragment: str | None, following: str | None, otherwise: Callable[[], str | None]) -> tuple[str, str | None, bool]:
    """(text, stored annotations, whether ranges didn't hold) of a section; ``otherwise`` gives the text of the whole page."""
    try:
        section = page.extract(fragment, following).cleaned()
    except (ValueError, LookupError, RecursionError):
        plain = otherwise() if fragment is None and following is None else page.plain_section(fragment, following)
        return plain, structured_json(plain, blocks_by_words(page, plain)) if plain else None, True
    return section.text, structured_json(section.text, section_blocks(section)) if section.text else None, False


def annotated_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, structured_json, fallback: each page's body as one cleaned and annotated section."""

    def kernel(page_id, html):
        source = units(html or "")
        words, stored, fallback = annotated(Page.passing(source), None, None, lambda: page_text(html or ""))
        yield page_id, from_units(words), stored, fallback

    return map_rows(pages.select(id_col, html_col), kernel, f"{_typed(pages, id_col)}, text string, structured_json string, fallback boolean")


def annotated_texts(texts: DataFrame, id_col: str, html_col: str, text_col: str) -> DataFrame:
    """id, text, structured_json: annotations of given texts, their blocks found by the words of their markup."""

    def kernel(text_id, html, words):
        own = units(words or "")
        yield text_id, words, structured_json(own, blocks_by_words(Page(units(html or "")), own))

    rows = texts.select(id_col, html_col, F.col(text_col).alias("text"))
    return map_rows(rows, kernel, f"{_typed(texts, id_col)}, text string, structured_json string")


_RANGES = "array<struct<start:int,end:int>>"
_EXTRACTED = f"text string, preserved {_RANGES}, elements array<struct<node_id:int,tag:string,ranges:{_RANGES}>>, start_node_id int, end_node_id int, error string"


def _extracted(page: Page, fragment: str | None, following: str | None) -> tuple:
    """A section's columns as in ``_EXTRACTED``; structs are tuples in the order of their fields."""
    try:
        got = page.extract(fragment, following)
    except ValueError as e:
        return None, None, None, None, None, str(e)
    elements = [(n.index, n.tag, rs) for n, rs in sorted(got.elements.items(), key=lambda x: x[0].index)]
    return from_units(got.text), got.preserved, elements, got.start and got.start.index, got.end and got.end.index, None


def extracted_sections(pages: DataFrame, id_col: str, html_col: str, fragment_col: str, following_col: str) -> DataFrame:
    """The input's id with text, preserved and elements (tag, ranges) of a section before cleaning, and its error if
    ranges don't hold. Offsets are UTF-16 units."""

    def kernel(page_id, html, fragment, following):
        yield page_id, *_extracted(Page(units(html or "")), fragment, following)

    return map_rows(pages.select(id_col, html_col, fragment_col, following_col), kernel, f"{_typed(pages, id_col)}, {_EXTRACTED}")


def page_sections(pages: DataFrame, id_col: str, html_col: str, asked_col: str) -> DataFrame:
    """``extracted_sections`` of pages with several sections each, parsed once for all of them; ``asked_col`` is an array
    of structs of fragment and following, which the rows come with."""

    def kernel(page_id, html, asked):
        page = Page(units(html or "")) if asked else None
        for each in asked or ():
            yield page_id, each["fragment"], each["following"], *_extracted(page, each["fragment"], each["following"])

    pair = "struct<fragment:string,following:string>"
    rows = pages.select(id_col, html_col, F.col(asked_col).cast(f"array<{pair}>").alias("asked"))
    return map_rows(rows, kernel, f"{_typed(pages, id_col)}, fragment string, following string, {_EXTRACTED}")


def blocks(sections: DataFrame, *keys: str, json_col: str = "structured_json") -> DataFrame:
    """One row a block: keys, block_no and the block's fields."""
    content = F.from_json(json_col, CONTENT)
    rows = sections.where(F.col(json_col).isNotNull()).select(*keys, F.posexplode(content["annotations"]).alias("block_no", "b"))
    return rows.select(*keys, "block_no", "b.*")


def marks(block_rows: DataFrame, *keys: str) -> DataFrame:
    """One row a mark: keys, block_no, mark_no and the mark's fields."""
    rows = block_rows.select(*keys, "block_no", F.posexplode("marks").alias("mark_no", "m"))
    return rows.select(*keys, "block_no", "mark_no", "m.*")


def shifted(blocks_col: Column, offset: Column) -> Column:
    """Blocks moved by an offset, with their marks and term ends."""

    def mark(m: Column) -> Column:
        return m.withField("start", m["start"] + offset).withField("end", m["end"] + offset)

    def block(b: Column) -> Column:
        moved = b.withField("start", b["start"] + offset).withField("end", b["end"] + offset)
        return moved.withField("definitionTermEnd", b["definitionTermEnd"] + offset).withField("marks", F.transform(b["marks"], mark))

    return F.transform(blocks_col, block)


def stored_blocks(json_col: Column, text_col: Column) -> Column:
    """The blocks of stored annotations if they are those of this text, else none."""
    content = F.from_json(json_col, CONTENT)
    none = F.from_json(F.lit("[]"), f"array<{BLOCK}>")
    return F.coalesce(F.when(content["baseTextHash"] == F.sha2(text_col, 256), content["annotations"]), none)


def stored(blocks_col: Column, text_col: Column) -> Column:
    """Blocks in their stored form; null without any."""
    content = F.struct(F.lit(1).alias("schemaVersion"), F.sha2(text_col, 256).alias("baseTextHash"), blocks_col.alias("annotations"))
    return F.when(F.size(blocks_col) > 0, F.to_json(content))


def parsed(stored_json: str | None) -> list[dict]:
    """Blocks of a stored form, in Python."""
    return json.loads(stored_json)["annotations"] if stored_json else []
