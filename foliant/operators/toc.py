"""Tables of contents as flat rows: book_id, pos (document order), depth, title, href.

Trees are implied by order and depth, so hierarchy questions are windows over a book's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

def in_book() -> W:
    return W.partitionBy("book_id").orderBy("pos")


def with_parents(toc: DataFrame) -> DataFrame:
    """Adds parent_pos and parent_title: of the nearest row before that is less deep; null at the top.

    A stack of the rows above is carried over a book's rows in order, so nesting may be of any depth; a book's table of
    contents is bounded by its archive.
    """
    row, above = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in toc.schema) + ">", "struct<d:int,p:bigint,t:string>"
    grouped = toc.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_at"), F.struct(*toc.columns).alias("r")))).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        r = x["r"]
        stack = F.filter(s["stack"], lambda e: e["d"] < r["depth"])
        own = F.struct(r["depth"].cast("int").alias("d"), r["pos"].cast("bigint").alias("p"), r["title"].alias("t"))
        found = F.struct(r.alias("r"), F.get(stack, F.size(stack) - 1).alias("up"))
        return F.struct(F.concat(stack, F.array(own)).alias("stack"), F.concat(s["out"], F.array(found)).alias("out"))

    start = F.struct(F.expr(f"cast(array() as array<{above}>)").alias("stack"), F.expr(f"cast(array() as array<struct<r:{row},up:{above}>>)").alias("out"))
    df = grouped.select(F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("x"))
    return df.select("x.r.*", F.col("x.up.p").alias("parent_pos"), F.col("x.up.t").alias("parent_title"))


def with_children(toc: DataFrame) -> DataFrame:
    """Adds is_section (has children), first_child_href and first_child_title."""
    below = F.lead("depth").over(in_book()) > F.col("depth")
    return toc.withColumns(
        {
            "is_section": F.coalesce(below, F.lit(False)),
            "first_child_href": F.when(below, F.lead("href").over(in_book())),
            "first_child_title": F.when(below, F.lead("title").over(in_book())),
        }
    )


def promoted_titles(toc: DataFrame) -> DataFrame:
    """Titles taken from the first child where that only adds a part's number to its parent's title."""
    df = with_children(toc.withColumn("title", F.coalesce(F.nullif(text.trimmed(F.col("title")), F.lit("")), F.lit("Untitled"))))
    same = F.lower(text.strip_part_prefix(F.col("first_child_title"))) == F.lower("title")
    return df.withColumn("title", F.when(same, F.col("first_child_title")).otherwise(F.col("title"))).drop("first_child_title")


def label(labels: Column) -> Column:
    """The first label that isn't blank, else 'Untitled'."""
    told = F.filter(F.transform(labels, text.trimmed), lambda x: x != "")
    return F.coalesce(F.get(told, F.lit(0)), F.lit("Untitled"))


def with_references(toc: DataFrame) -> DataFrame:
    """Adds file and fragment of the href."""
    return toc.withColumns({"file": text.href_file(F.col("href")), "fragment": text.href_fragment(F.col("href"))})


def with_next_fragment(toc: DataFrame) -> DataFrame:
    """Adds next_fragment: the next one in the same run of entries of a file; rows without href don't break a run."""
    book = in_book()
    linked = toc.where(F.col("href").isNotNull())
    changed = F.coalesce((F.lag("file").over(book) != F.col("file")).cast("int"), F.lit(0))
    runs = linked.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(book))
    after = W.partitionBy("book_id", "_run").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    found = runs.withColumn("next_fragment", F.first("fragment", ignorenulls=True).over(after)).drop("_changed", "_run")
    return found.unionByName(toc.where(F.col("href").isNull()).withColumn("next_fragment", F.lit(None).cast("string")))


def title_wrapper(document_title: Column) -> Column:
    """Whether a row with children only wraps the book in its own title."""
    own = text.normalize_title(document_title)
    return (F.col("depth") == 0) & F.col("is_section") & F.col("fragment").isNull() & (own != "") & (text.normalize_title(F.col("title")) == own)


def spine_order(chapters: DataFrame) -> DataFrame:
    """book_id, file, spine_pos: files in order of first mention."""
    first = chapters.where(F.col("file").isNotNull()).groupBy("book_id", "file").agg(F.min("pos").alias("pos"))
    return first.select("book_id", "file", (F.row_number().over(in_book()) - 1).alias("spine_pos"))


def chapter_index(chapters: DataFrame) -> DataFrame:
    """The first row with text of each HTML file, numbered by spine_index without gaps; rows have book_id, pos, file, text."""
    told = chapters.where(text.is_html_file(F.col("file")) & text.trimmed(F.col("text")).rlike("."))
    first = told.withColumn("_n", F.row_number().over(W.partitionBy("book_id", "file").orderBy("pos"))).where("_n = 1").drop("_n")
    return first.withColumn("spine_index", F.row_number().over(in_book()) - 1)


def last_html(chapters: DataFrame) -> DataFrame:
    """book_id, file, html: the last one told for a file."""
    return chapters.where("file is not null and html is not null").groupBy("book_id", "file").agg(F.max_by("html", "pos").alias("html"))


def counts(toc: DataFrame) -> DataFrame:
    """book_id, entries, top_entries, deepest."""
    return toc.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum((F.col("depth") == 0).cast("long")).alias("top_entries"), F.max("depth").alias("deepest")
    )
