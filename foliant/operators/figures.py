"""Figures: images of chapters, their sections, bytes and stored paths."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.cleaning import units
from ..functions.dom import parse
from ..functions.media import decode_data_uri, image_reference, resolve, safe_svg
from ..plans.rows import map_rows
from ..sources.guards import Limits
from .pages import BLOCK, stored_blocks
from .toc import last_html, spine_order


def section_folder_names(book_id: Column, owner: Column, index: Column, ext: Column) -> Column:
    """The default names of stored images: book, section, number."""
    return F.concat(F.sha2(book_id, 256).substr(1, 16), F.lit("/"), F.coalesce(owner.cast("string"), F.lit("root")), F.lit("-"), index.cast("string"), F.lit("."), ext)


def references(chapter_html: DataFrame, sections: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every image of every chapter in document order, with its owner: the section whose anchor was passed last, else the
    first of the chapter's sections without one, else the first; owner_pos is null if the chapter has no section."""
    files = spine_order(chapter_html).join(last_html(chapter_html), ["book_id", "file"])
    of_file = sections.where("location.href is not null").groupBy("book_id", F.col("location.href").alias("file")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("location.anchor").alias("anchor")))).alias("sections")
    )

    def kernel(book_id, file, spine_pos, html, owners):
        index, seen = 0, {}
        doc = parse(units(html))
        for node in doc.nodes[doc.body.index :]:
            if not node.tag:
                continue
            if node.attrs.get("id"):
                seen[node.attrs["id"]] = index
            found = image_reference(node)
            if found is None:
                continue
            passed = [(seen[s["anchor"]], s["pos"]) for s in owners or () if s["anchor"] is not None and s["anchor"] in seen]
            free = [s["pos"] for s in owners or () if s["anchor"] is None]
            owner = max(passed)[1] if passed else free[0] if free else owners[0]["pos"] if owners else None
            target, source = found
            path, reason, media, data = None, None, None, None
            if source == "epub_data_uri":
                if len(target) - target.find(",") - 1 > 2 * limits.max_data_uri_bytes and "," in target:
                    reason = "data URI too long"
                elif (decoded := decode_data_uri(target)) is None:
                    reason = "malformed data URI"
                elif len(decoded[1]) > limits.max_data_uri_bytes:
                    reason = "data URI too long"
                else:
                    media, data = decoded
            else:
                path, reason = resolve(file, target)
            tries = list(dict.fromkeys([path, unquote(path), path.removeprefix("/")])) if path else None
            yield book_id, file, spine_pos, index, source, owner, path, tries, media, data, reason
            index += 1

    rows = files.join(of_file, ["book_id", "file"], "left").select("book_id", "file", "spine_pos", "html", "sections")
    schema = (
        "book_id string, chapter_href string, spine_pos int, dom_index int, source string, owner_pos long, path string, tries array<string>,"
        " media string, data binary, reject_reason string"
    )
    return map_rows(rows, kernel, schema)


def data_uris(df: DataFrame, id_col: str, uri_col: str) -> DataFrame:
    """id, media, data, ext of data URIs; null where one is malformed or none."""

    def kernel(row_id, uri):
        yield row_id, *(decode_data_uri(uri or "") or (None, None))

    found = map_rows(df.select(id_col, uri_col), kernel, f"{id_col} {dict(df.dtypes)[id_col]}, media string, data binary")
    return found.withColumn("ext", text.extension_of_mime(F.col("media")))


def vector_safety(df: DataFrame, id_col: str, svg_col: str) -> DataFrame:
    """id, safe: whether a vector graphic has no document type, entities or targets outside of the archive."""

    def kernel(row_id, svg):
        yield row_id, None if svg is None else safe_svg(bytes(svg))

    return map_rows(df.select(id_col, svg_col), kernel, f"{id_col} {dict(df.dtypes)[id_col]}, safe boolean")


def with_bytes(refs: DataFrame, images: DataFrame) -> DataFrame:
    """References with the bytes that they lead to: as told, else with escapes decoded, else without a leading slash."""
    asked = refs.where("tries is not null").select("book_id", "chapter_href", "dom_index", F.posexplode("tries").alias("n", "href"))
    met = asked.join(images.select("book_id", "href", F.col("data").alias("found")), ["book_id", "href"])
    best = met.groupBy("book_id", "chapter_href", "dom_index").agg(F.min_by("found", "n").alias("found"))
    df = refs.join(best, ["book_id", "chapter_href", "dom_index"], "left")
    data = F.coalesce("data", "found")
    ext = F.coalesce(F.when(F.col("source") == "epub_data_uri", text.extension_of_mime(F.col("media"))).otherwise(text.extension_of_path(F.col("path"))), F.lit("png"))
    df = df.withColumns({"bytes": data, "ext": ext}).drop("data", "found", "tries", "media")
    safe = F.udf(lambda raw: None if raw is None else safe_svg(bytes(raw)), "boolean", useArrow=True)
    unsafe = ~F.coalesce(safe(F.when(F.col("ext") == "svg", F.col("bytes"))), F.lit(True))  # only vector graphics go to Python
    reason = F.coalesce("reject_reason", F.when(F.col("bytes").isNull(), "not in the archive"), F.when(unsafe, "unsafe SVG"))
    return df.withColumn("reject_reason", reason)


def figures(refs: DataFrame, naming: Callable[[Column, Column, Column, Column], Column] = section_folder_names) -> DataFrame:
    """Stored figures: equal images of a book share the path of the first. Numbers within a section count what is stored."""
    df = refs.where("reject_reason is null").withColumn("sha256", F.sha2("bytes", 256))
    order = ["spine_pos", "dom_index"]
    local = F.row_number().over(W.partitionBy("book_id", "owner_pos").orderBy(*order)) - 1
    df = df.withColumn("section_local_index", local)
    own = naming(F.col("book_id"), F.col("owner_pos"), F.col("section_local_index"), F.col("ext"))
    df = df.withColumn("path", F.first(own).over(W.partitionBy("book_id", "sha256").orderBy(*order)))
    inside = ~(F.col("path").startswith("/") | F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)"))
    return df.where(inside).select(
        "book_id", "chapter_href", "spine_pos", "dom_index", F.concat_ws(":", "chapter_href", F.col("dom_index").cast("string")).alias("anchor"),
        "source", "ext", "sha256", "path", "owner_pos", "section_local_index", "bytes",
    )


def anchor_paths(figs: DataFrame) -> DataFrame:
    """book_id, anchor, path; of equal anchors the last."""
    return figs.groupBy("book_id", "anchor").agg(F.max_by("path", F.struct("spine_pos", "dom_index")).alias("path"))


def by_section(figs: DataFrame) -> DataFrame:
    """book_id, owner_pos, paths in document order."""
    listed = F.array_sort(F.collect_list(F.struct("spine_pos", "dom_index", "path")))
    return figs.groupBy("book_id", "owner_pos").agg(F.transform(listed, lambda s: s["path"]).alias("paths"))


def with_images(sections: DataFrame, figs: DataFrame) -> DataFrame:
    """Sections with an image block for each of their figures at the end of their text; sections without text stay."""
    paths = by_section(figs).withColumnRenamed("owner_pos", "pos")
    df = sections.join(paths, ["book_id", "pos"], "left")
    end = text.utf16_length(F.col("text"))
    image = F.from_json(F.lit('{"type":"image","marks":[]}'), BLOCK)
    added = F.transform("paths", lambda p: image.withField("start", end).withField("end", end).withField("imagePath", p))
    whole = F.concat(stored_blocks(F.col("structured_json"), F.col("text")), added)
    content = F.struct(F.lit(1).alias("schemaVersion"), F.sha2("text", 256).alias("baseTextHash"), whole.alias("annotations"))
    has = F.col("text").isNotNull() & (F.size("paths") > 0)
    return df.withColumn("structured_json", F.when(has, F.to_json(content)).otherwise(F.col("structured_json"))).drop("paths")


def write_images(figs: DataFrame, path: str) -> None:
    """One row per distinct stored image as Parquet: book_id, path, sha256 and bytes, in a few large files."""
    figs.dropDuplicates(["book_id", "path"]).select("book_id", "path", "sha256", "bytes").write.mode("overwrite").parquet(path)
