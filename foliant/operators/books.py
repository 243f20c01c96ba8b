"""Books: chapters, annotated sections and the section tree, from the rows that ``sources.epub`` reads."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.cleaning import from_units, units
from ..functions.sections import Page, page_text, page_title
from ..plans.lineage import written
from ..plans.rows import map_rows
from . import toc
from .pages import annotated, shifted, stored, stored_blocks

#: Sections of more UTF-16 units than this are flagged.
LONG_SECTION = 50_000


@dataclass(frozen=True)
class Book:
    """The tables of a set of books."""

    books: DataFrame
    chapters: DataFrame
    toc: DataFrame
    sections: DataFrame


def chapter_texts(chapter_html: DataFrame, fix_breaks: bool = True) -> DataFrame:
    """book_id, spine_index, file, title, text, confidence: a chapter for each file with text, its text cleaned."""
    html = chapter_html.where(F.col("html").isNotNull() & (F.col("html") != "") & text.is_html_file(F.col("file")))

    def kernel(book_id, pos, file, title, source, base):
        yield book_id, pos, file, title or from_units(page_title(source) or base or ""), from_units(page_text(source))

    rows = html.select("book_id", "pos", "file", "title", "html", text.base_name(F.col("file")).alias("base"))
    told = toc.chapter_index(map_rows(rows, kernel, "book_id string, pos long, file string, title string, text string"))
    words = text.clean_text(F.col("text")) if fix_breaks else F.col("text")
    return told.select("book_id", "spine_index", "file", "title", words.alias("text"), F.lit(1.0).alias("confidence"))


def prepared_toc(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Table of contents with all that sections are made from."""
    rows = toc.with_references(toc.promoted_titles(entries))
    rows = toc.with_next_fragment(toc.with_parents(rows))
    titled = rows.join(books.select("book_id", F.col("title").alias("_book")), "book_id", "left")
    return titled.withColumn("wrapper", toc.title_wrapper(F.col("_book"))).drop("_book")


def sections(entries: DataFrame, chapters: DataFrame, chapter_html: DataFrame) -> DataFrame:
    """One row an entry of ``prepared_toc``: location, text, stored annotations and flags.

    A file's HTML is parsed once for all of its entries. Entries without a known chapter stay as placeholders
    (spine_index -1, no text) if they have children; others go, and as they have none no row loses its parent.
    """
    known = entries.join(chapters.select("book_id", "file", "spine_index", F.col("text").alias("chapter_text")), ["book_id", "file"], "left")
    asked = known.where("spine_index is not null").groupBy("book_id", "file").agg(
        F.collect_list(F.struct("pos", "fragment", "next_fragment")).alias("asked"), F.first("chapter_text").alias("chapter_text")
    )
    html = toc.last_html(chapter_html)

    def kernel(book_id, file, wanted, chapter_text, source):
        page = Page(units(source)) if source is not None else None
        for entry in wanted:
            if page is None:
                yield book_id, entry["pos"], chapter_text, None, False
            else:
                words, kept, fallback = annotated(page, entry["fragment"], entry["next_fragment"], lambda: chapter_text)
                yield book_id, entry["pos"], from_units(words), kept, fallback

    made = map_rows(
        asked.join(html, ["book_id", "file"], "left").select("book_id", "file", "asked", "chapter_text", "html"),
        kernel,
        "book_id string, pos long, text string, structured_json string, fallback boolean",
    )
    rows = known.drop("chapter_text").join(made, ["book_id", "pos"], "left").where("spine_index is not null or is_section")
    location = F.when(
        F.col("spine_index").isNull(),
        F.struct(F.lit(-1).alias("spine_index"), F.lit(None).cast("int").alias("end_spine_index"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("anchor")),
    ).otherwise(F.struct(F.col("spine_index").cast("int").alias("spine_index"), F.lit(None).cast("int").alias("end_spine_index"), F.col("file").alias("href"), F.col("fragment").alias("anchor")))
    return rows.select(
        "book_id", "pos", "parent_pos", "depth", "title", location.alias("location"), "text", "structured_json",
        F.coalesce("fallback", F.lit(False)).alias("fallback"), (F.coalesce("wrapper", F.lit(False)) & F.col("spine_index").isNotNull()).alias("wrapper"),
        F.when(text.utf16_length(F.col("text")) > LONG_SECTION, "long").when(F.col("text") == "", "empty").alias("warning"),
    )


def merged_wrappers(rows: DataFrame) -> DataFrame:
    """Rows that only wrap a book in its title give their text to their first child and go; their children move up."""
    heads = rows.where("wrapper").select("book_id", F.col("pos").alias("_wpos"), F.col("text").alias("_wtext"), F.col("structured_json").alias("_wjson"), F.col("parent_pos").alias("_wparent"))
    df = rows.where("not wrapper").join(heads.withColumnRenamed("_wpos", "parent_pos"), ["book_id", "parent_pos"], "left")
    first = df.where("_wtext is not null").groupBy("book_id", "parent_pos").agg(F.min("pos").alias("pos")).withColumn("_first", F.lit(True))
    df = df.join(first, ["book_id", "parent_pos", "pos"], "left")
    takes = F.coalesce(F.col("_first"), F.lit(False)) & (text.trimmed(F.col("_wtext")) != "")
    own = F.coalesce("text", F.lit(""))
    gap = F.when(own == "", "").otherwise("\n\n")
    whole = F.concat(F.col("_wtext"), gap, own)
    moved = shifted(stored_blocks(F.col("structured_json"), own), text.utf16_length(F.col("_wtext")) + F.length(gap))
    both = F.concat(stored_blocks(F.col("_wjson"), F.col("_wtext")), moved)
    is_child = F.col("_wtext").isNotNull()
    return df.select(
        "book_id", "pos", F.when(is_child, F.col("_wparent")).otherwise(F.col("parent_pos")).alias("parent_pos"), "depth", "title", "location",
        F.when(takes, whole).otherwise(F.col("text")).alias("text"),
        F.when(takes, stored(both, whole)).otherwise(F.col("structured_json")).alias("structured_json"),
        "fallback", "warning",
    )


def book_json(books: DataFrame, rows: DataFrame) -> DataFrame:
    """book_id, json: the ordered section tree of each book (a book's table of contents is bounded by its archive)."""
    row = F.struct("pos", "parent_pos", "title", "location", "text", "structured_json")
    grouped = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def kernel(book_id, title, found):
        root = {"title": title or "", "location": {"spine_index": 0}, "pos": None}
        children: dict = {}
        for r in found or ():
            children.setdefault(r["parent_pos"], []).append(r)

        def form(section):
            where = section["location"]
            location = {"type": "epub_chapter", "spine_index": where["spine_index"]}
            location |= {k: where[k] for k in ("end_spine_index", "href", "anchor") if where.get(k) is not None}
            out = {"type": "section", "title": section["title"], "location": location}
            if section.get("text") is not None:
                out["content"] = [section["text"]]
            if section.get("structured_json") is not None:
                out["structuredContentJson"] = section["structured_json"]
            below = children.get(section["pos"], [])
            if below:
                out["subsections"] = [form(s) for s in below]
            return out

        yield book_id, json.dumps(form(root), ensure_ascii=False)

    return map_rows(books.select("book_id", "title").join(grouped, "book_id", "left"), kernel, "book_id string, json string")


def extract(archives: dict[str, DataFrame], fix_breaks: bool = True, with_sections: bool = True) -> Book:
    """All tables of the books read by ``sources.epub.read_books``; chapters and sections are made once and written."""
    chapters = written(chapter_texts(archives["chapter_html"], fix_breaks))
    entries = prepared_toc(archives["toc"], archives["books"])
    rows = sections(entries, chapters, archives["chapter_html"])
    rows = written(merged_wrappers(written(rows))) if with_sections else rows.limit(0)
    return Book(archives["books"], chapters, entries, rows)
