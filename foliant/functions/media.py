"""Images in markup: references, data URIs, paths and unsafe vector graphics."""

from __future__ import annotations

import base64
import binascii
import posixpath
import re
from urllib.parse import unquote

from .charsets import TRIM_CHARS
from .dom import Node

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_NUMERIC = re.compile(r"&#(?:([0-9]{1,7})|x([0-9a-fA-F]{1,6}));")
_TARGET = re.compile(r"(?:xlink:href|href)\s*=\s*[\"']([^\"']*)[\"']", re.I)


def image_reference(node: Node) -> tuple[str, str] | None:
    """(target, source kind) of an img or svg image element; none for others and for blank targets."""
    names = {"img": ("src",), "image": ("xlink:href", "href")}.get(node.tag, ())
    target = next((t for name in names if (t := node.attrs.get(name, "").strip(TRIM_CHARS))), None)
    if target is None:
        return None
    return target, "epub_data_uri" if target.startswith("data:") else "epub_img_tag" if node.tag == "img" else "epub_svg_image"


def decode_data_uri(uri: str) -> tuple[str, bytes] | None:
    """(media type, bytes) of a data URI; none if it is malformed."""
    if not uri.startswith("data:") or "," not in uri:
        return None
    meta, payload = uri[5:].split(",", 1)
    try:
        if ";base64" in meta.lower():
            data = base64.b64decode(payload, validate=True)
        elif re.search(r"%(?![0-9A-Fa-f]{2})", payload):
            return None
        else:
            data = unquote(payload, errors="strict").encode()
    except (binascii.Error, ValueError):
        return None
    return meta.split(";")[0].strip(), data


def decode_numeric(text: str) -> str:
    """Numeric character references decoded; those of no character stay."""

    def one(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if code <= 0x10FFFF else m[0]

    return _NUMERIC.sub(one, text)


def safe_svg(data: bytes) -> bool:
    """Whether a vector graphic has no document type, entities, or targets outside of the archive."""
    text = data.decode("utf-8", "replace")
    low = text.lower()
    if "<!doctype" in low or "<!entity" in low:
        return False
    for target in _TARGET.findall(text):
        value = decode_numeric(target.strip(TRIM_CHARS)).lower()
        if value and not value.startswith(("#", "data:")) and ":" in value:
            return False
    return True


def resolve(chapter: str, target: str) -> tuple[str | None, str | None]:
    """(path in the archive, reason for which there is none) of a chapter's image target."""
    if _SCHEME.match(target) and not re.match(r"[A-Za-z]:[\\/]", target):
        return None, "not a relative reference"
    path = target.partition("#")[0]
    if "\\" in path or re.match(r"[A-Za-z]:", path):
        return None, "windows path"
    folder = posixpath.dirname(chapter)
    found = path if folder in ("", ".") else posixpath.normpath(posixpath.join(folder, path))
    if found.startswith(("..", "/")) or "/../" in found:
        return None, "outside of the archive"
    return found, None
