"""EPUB archives as DataFrames: books, tables of contents, chapter HTML and images."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charsets import TRIM_CHARS
from ..functions.dom import Node, parse
from ..plans.lineage import written
from ..plans.rows import map_rows
from .guards import GuardError, Limits, check

_HTML_TYPES = ("application/xhtml+xml", "text/html")
#: Fixed value: characters that stay escaped in a decoded reference.
_RESERVED = ";/?:@&=+$,#"
_SCHEMA = (
    "book_id string, kind string, pos long, depth int, title string, labels array<string>, href string, html string, media string, data binary,"
    " authors array<string>, error string"
)


def decode_path(path: str) -> str:
    """A path with its escapes decoded, but for those of reserved characters; itself if one is malformed."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", path):
        return path
    kept = re.compile("|".join(f"%{ord(c):02X}" for c in _RESERVED), re.I)
    out, at = [], 0
    try:
        for m in kept.finditer(path):
            out += [unquote(path[at : m.start()], errors="strict"), m[0]]
            at = m.end()
        return "".join([*out, unquote(path[at:], errors="strict")])
    except UnicodeDecodeError:
        return path


def navigation_href(href: str | None) -> str | None:
    """A reference with its path decoded and its fragment as it is; none for blank ones."""
    value = (href or "").strip(TRIM_CHARS)
    path, mark, fragment = value.partition("#")
    return decode_path(path) + mark + fragment if value else None


def _xml(raw: bytes | None) -> ET.Element | None:
    """A parsed document; none if there isn't one, or if it brings a document type with declarations of its own."""
    if raw is None or b"<!ENTITY" in raw:
        return None
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(root: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == name) if root is not None else iter(())


def _one(root: ET.Element | None, name: str) -> ET.Element | None:
    return next(_all(root, name), None)


def _ncx_points(at: ET.Element, depth: int) -> Iterator[tuple[int, list[str], str | None]]:
    for point in at:
        if _local(point.tag) == "navPoint":
            labels = ["".join(t.itertext()) for e in point if _local(e.tag) == "navLabel" for t in _all(e, "text")]
            content = next((e.get("src") for e in point if _local(e.tag) == "content"), None)
            yield depth, labels, content
            yield from _ncx_points(point, depth + 1)


def _nav_points(at: Node, depth: int) -> Iterator[tuple[int, list[str], str | None]]:
    for item in at.elements():
        if item.tag == "li":
            head = next((n for n in item.elements() if n.tag in ("a", "span")), None)
            yield depth, [re.sub(r"\s+", " ", head.text())] if head is not None else [], head.attrs.get("href") if head is not None else None
            for below in item.elements():
                if below.tag == "ol":
                    yield from _nav_points(below, depth + 1)


def _from_dir(base: str, href: str | None) -> str | None:
    """A reference of a document in ``base`` as one from the package's folder."""
    if not href or href.startswith("#") or not base:
        return href
    path, mark, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(base, path)) + mark + fragment


def archive_rows(book_id: str, raw: bytes, limits: Limits) -> Iterator[tuple]:
    """The rows of one archive, each with a kind: book, toc, chapter or image. A bad archive gives a book row with its error."""

    def row(kind: str, pos: int = 0, depth: int | None = None, title=None, labels=None, href=None, html=None, media=None, data=None, authors=None, error=None):
        return book_id, kind, pos, depth, title, labels, href, html, media, data, authors, error

    try:
        if len(raw) > limits.max_bytes:
            raise GuardError(f"archive has {len(raw)} bytes, exceeds EPUB_MAX_BYTES={limits.max_bytes}")
        check(raw, limits)
        files = zipfile.ZipFile(io.BytesIO(raw))
        names = set(files.namelist())

        def load(name: str) -> bytes | None:
            return files.read(name) if name in names else None

        container = _one(_xml(load("META-INF/container.xml")), "rootfile")
        package_name = container.get("full-path") if container is not None else None
        package = _xml(load(package_name)) if package_name else None
        if package is None:
            raise GuardError("archive has no readable package document")
        base = posixpath.dirname(package_name)
        items = {e.get("id"): e for e in _all(package, "item")}

        def path_of(href: str) -> str:
            joined = posixpath.normpath(posixpath.join(base, href))
            return joined if joined in names else posixpath.normpath(posixpath.join(base, unquote(href)))

        metadata = _one(package, "metadata")
        title = next((("".join(e.itertext())).strip() for e in _all(metadata, "title")), None)
        authors = [("".join(e.itertext())).strip() for e in _all(metadata, "creator")]
        yield row("book", title=title, authors=authors)

        spine = _one(package, "spine")
        ncx = items.get(spine.get("toc")) if spine is not None else None
        ncx = ncx if ncx is not None else next((e for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
        nav = next((e for e in items.values() if "nav" in (e.get("properties") or "").split()), None)
        points: list[tuple[int, list[str], str | None]] = []
        if nav is not None and (source := load(path_of(nav.get("href")))) is not None:
            navs = [n for n in parse(source.decode("utf-8", "replace")).nodes if n.tag == "nav"]
            chosen = next((n for n in navs if "toc" in n.attrs.get("epub:type", "").split()), navs[0] if navs else None)
            top = chosen.first({"ol"}) if chosen is not None else None
            found = list(_nav_points(top, 0)) if top is not None else []
            points = [(d, t, _from_dir(posixpath.dirname(nav.get("href")), h)) for d, t, h in found]
        if not points and ncx is not None:
            tree = _one(_xml(load(path_of(ncx.get("href")))), "navMap")
            found = list(_ncx_points(tree, 0)) if tree is not None else []
            points = [(d, t, _from_dir(posixpath.dirname(ncx.get("href")), h)) for d, t, h in found]
        told = [(depth, labels, navigation_href(href)) for depth, labels, href in points]

        html: dict[str, str] = {}
        for item in items.values():
            if item.get("media-type") in _HTML_TYPES and (source := load(path_of(item.get("href")))) is not None:
                html[decode_path(item.get("href"))] = source.decode("utf-8-sig", "replace")
        files_told = [(href or "").partition("#")[0] for _, _, href in told]
        order = [decode_path(items[e.get("idref")].get("href")) for e in _all(spine, "itemref") if e.get("idref") in items]
        if not told:  # without navigation the reading order is the table of contents
            told = [(0, [], href) for href in order]
        for pos, (depth, labels, href) in enumerate(told):
            yield row("toc", pos, depth, labels=labels, href=href)
        # Chapters: entries of the navigation, and files of the reading order that it leaves out, each before the next that follows it there.
        chapters: list[tuple[str, str | None]] = []
        left = [f for f in order if f not in files_told]
        place = {f: i for i, f in enumerate(order)}
        for (_, labels, _), file in zip(told, files_told) if files_told else ():
            while left and place.get(file, -1) > place[left[0]]:
                chapters.append((left.pop(0), None))
            chapters.append((file, next((t.strip(TRIM_CHARS) for t in labels if t.strip(TRIM_CHARS)), None)))
        chapters += [(f, None) for f in left]
        for pos, (file, name) in enumerate(chapters):
            yield row("chapter", pos, title=name, href=file, html=html.get(file))
        images = sorted(items.values(), key=lambda e: e.get("href"))
        for pos, item in enumerate(images):
            if (item.get("media-type") or "").lower().startswith("image/") and (data := load(path_of(item.get("href")))) is not None:
                yield row("image", pos, href=decode_path(item.get("href")), media=item.get("media-type"), data=data)
    except GuardError as e:
        yield row("book", error=str(e))
    except Exception as e:  # a broken archive is its book's error, not the job's
        yield row("book", error=f"failed to read EPUB archive: {e}")


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """path, length, content of the archives below a path. Archives over the size limit aren't read, their content is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    within = files.where(F.col("length") <= limits.max_bytes).select("path", "length", "content")
    return within.unionByName(files.where(F.col("length") > limits.max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content")))


def book_tables(archives: DataFrame, limits: Limits = Limits(), id_col: str = "path", content_col: str = "content", once: bool = True) -> dict[str, DataFrame]:
    """books, toc, chapter_html and images of the archives in a column; bad archives are rows of books with guard_error.

    Archives are read and parsed once, in this call: their rows are written to the shared folder, a part for each table.
    With ``once`` off (streams) nothing is written, and each use of a table reads the archives again.
    """

    def kernel(book_id, content):
        if content is None:
            yield book_id, "book", 0, *[None] * 8, f"archive exceeds EPUB_MAX_BYTES={limits.max_bytes}"
        else:
            yield from archive_rows(book_id, bytes(content), limits)

    rows = map_rows(archives.select(F.col(id_col).cast("string"), content_col), kernel, _SCHEMA)
    rows = written(rows, "kind") if once else rows

    def of(kind: str) -> DataFrame:
        return rows.where(F.col("kind") == kind)

    from ..operators.toc import label

    books = of("book").select("book_id", "title", F.get("authors", F.lit(0)).alias("author"), "authors", F.col("error").alias("guard_error"))
    return {
        "books": books,
        "toc": of("toc").select("book_id", "pos", "depth", label(F.col("labels")).alias("title"), "href"),
        "chapter_html": of("chapter").select("book_id", "pos", F.col("href").alias("file"), "title", "html"),
        "images": of("image").select("book_id", "href", "media", "data"),
    }


def read_books(spark: SparkSession, path: str, limits: Limits = Limits()) -> dict[str, DataFrame]:
    return book_tables(read_archives(spark, path, limits), limits)


def guard_report(archives: DataFrame, limits: Limits = Limits(), id_col: str = "path", content_col: str = "content") -> DataFrame:
    """id, ok, error, entries, declared_bytes of each archive."""

    def kernel(book_id, content):
        try:
            yield book_id, True, None, *check(bytes(content or b""), limits)
        except GuardError as e:
            yield book_id, False, str(e), None, None

    return map_rows(archives.select(F.col(id_col).cast("string"), content_col), kernel, "book_id string, ok boolean, error string, entries int, declared_bytes long")
