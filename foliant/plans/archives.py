"""EPUB archives made from pages: the sink that is the opposite of the source."""

from __future__ import annotations

import io
import zipfile
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

_CONTAINER = (
    '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)
_PNG = b"\x89PNG\r\n\x1a\n"


def archive(title: str, chapters: list[tuple[str, str, str]], entries: list[tuple[int, str, str]], images: dict[str, bytes]) -> bytes:
    """An EPUB of chapters (file, title, html), table-of-contents entries (depth, title, href) and images by path."""
    items = [f'<item id="c{i}" href="{escape(f)}" media-type="application/xhtml+xml"/>' for i, (f, _, _) in enumerate(chapters)]
    kinds = {"png": "image/png", "svg": "image/svg+xml", "jpg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}
    items += [f'<item id="i{i}" href="{escape(f)}" media-type="{kinds.get(f.rpartition(".")[2], "image/png")}"/>' for i, f in enumerate(images)]
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    package = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:creator>Nobody</dc:creator></metadata>'
        f'<manifest>{"".join(items)}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{spine}</spine></package>'
    )
    points, depth = [], -1
    for level, name, href in entries:
        points.append("</navPoint>" * (depth - level + 1))
        points.append(f"<navPoint><navLabel><text>{escape(name)}</text></navLabel><content src={chr(34)}{escape(href)}{chr(34)}/>")
        depth = level
    points.append("</navPoint>" * (depth + 1))
    ncx = f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{"".join(points)}</navMap></ncx>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", _CONTAINER)
        z.writestr("OEBPS/package.opf", package)
        z.writestr("OEBPS/toc.ncx", ncx)
        for file, _, html in chapters:
            z.writestr(f"OEBPS/{file}", html)
        for file, data in images.items():
            z.writestr(f"OEBPS/{file}", data)
    return out.getvalue()


def packed(pages: DataFrame, each: int = 10) -> DataFrame:
    """path, content: an archive for every ``each`` pages in order of page_id, a chapter for each page.

    Chapters show their own picture, one that all share, and one that isn't there; the first entry wraps the book.
    """

    def kernel(book, found):
        chapters, entries, images = [], [(0, f"Book {book}", "c0.xhtml")], {"images/shared.png": _PNG + b"shared"}
        for i, (page_id, html) in enumerate(sorted((r["page_id"], r["html"] or "") for r in found)):
            pictures = f'<h2 id="f{page_id}">Pictures</h2><p><img src="images/{page_id}.png"/><img src="images/shared.png"/><img src="../../x.png"/></p>'
            chapters.append((f"c{i}.xhtml", f"Page {page_id}", html.replace("</article>", f"{pictures}</article>")))
            images[f"images/{page_id}.png"] = _PNG + str(page_id).encode()
            entries += [(1, f"Page {page_id}", f"c{i}.xhtml"), (2, "Pictures", f"c{i}.xhtml#f{page_id}")]
        yield f"book-{book}.epub", archive(f"Book {book}", chapters, entries, images)

    grouped = pages.groupBy(F.floor(F.col("page_id") / each).cast("long").alias("book")).agg(F.collect_list(F.struct("page_id", "html")).alias("found"))
    return map_rows(grouped, kernel, "path string, content binary")
