"""Checks of an archive before anything in it is decompressed."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Mapping
from dataclasses import dataclass

MB = 1024 * 1024
#: Limits of an entry, its expansion, and the directory bytes allowed for each entry.
ENTRY_BYTES = 50 * MB
EXPANSION = 100
HEADER_BYTES = 512

_END, _END64, _HEADER = b"PK\x05\x06", b"PK\x06\x07", b"PK\x01\x02"


class GuardError(ValueError):
    """An archive that is not to be read."""


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 100 * MB
    max_entries: int = 5000
    max_text_bytes: int = 200 * MB
    max_data_uri_bytes: int = 10 * MB

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Limits:
        """Limits from EPUB_MAX_BYTES, EPUB_MAX_ENTRIES, EPUB_MAX_TEXT_BYTES and EPUB_MAX_DATA_URI_BYTES."""
        found = {}
        for name in ("max_bytes", "max_entries", "max_text_bytes", "max_data_uri_bytes"):
            raw = env.get(f"EPUB_{name.upper()}")
            if raw:
                try:
                    found[name] = int(raw.strip())
                except ValueError:
                    found[name] = 0
                if found[name] <= 0:
                    raise ValueError(f'EPUB_{name.upper()} must be a positive integer (got "{raw}")')
        return cls(**found)


def _end_record(raw: bytes) -> tuple[int, int, int, int] | None:
    """(place, entries, directory size, directory offset) of the last end-of-directory record near the end."""
    last = len(raw) - 22
    at = raw.rfind(_END, max(0, last - 0xFFFF), last + 4) if last >= 0 else -1
    return (at, *struct.unpack_from("<HII", raw, at + 10)) if at >= 0 else None


def directory_headers(raw: bytes, start: int, size: int, most: int) -> int:
    """Directory headers one after the other from ``start``, counted up to one more than ``most``."""
    end, count, at = start + size, 0, start
    if end > len(raw):
        return 0
    while at + 46 <= end and raw[at : at + 4] == _HEADER and count <= most:
        count += 1
        at += 46 + sum(struct.unpack_from("<HHH", raw, at + 28))
    return count


def check(raw: bytes, limits: Limits = Limits()) -> tuple[int, int]:
    """(entries, declared bytes) of an archive; GuardError if it breaks a limit. The cheap checks come first."""
    found = _end_record(raw)
    if found is None:
        raise GuardError("archive has no readable End-Of-Central-Directory record")
    at, entries, size, offset = found
    if entries == 0xFFFF or 0xFFFFFFFF in (size, offset) or raw[max(0, at - 20) : max(0, at - 16)] == _END64 and at >= 20:
        raise GuardError("archive declares ZIP64-sized fields or carries a ZIP64 locator; not supported")
    if entries > limits.max_entries:
        raise GuardError(f"archive declares {entries} archive entries, exceeds EPUB_MAX_ENTRIES={limits.max_entries}")
    if directory_headers(raw, offset, size, limits.max_entries) > limits.max_entries:
        raise GuardError(f"central directory contains > {limits.max_entries} records (signature scan); exceeds EPUB_MAX_ENTRIES")
    if size > limits.max_entries * HEADER_BYTES:
        raise GuardError(f"central directory size {size} bytes exceeds plausible bound {limits.max_entries * HEADER_BYTES}")
    try:
        infos = zipfile.ZipFile(io.BytesIO(raw)).infolist()
    except Exception as e:
        raise GuardError(f"failed to read EPUB archive: {e}") from e
    if len(infos) > limits.max_entries:
        raise GuardError(f"archive has {len(infos)} archive entries, exceeds EPUB_MAX_ENTRIES={limits.max_entries}")
    total = 0
    for info in infos:
        if info.is_dir():
            continue
        if info.file_size > ENTRY_BYTES:
            raise GuardError(f'entry "{info.filename}" declares uncompressed size {info.file_size}, exceeds per-entry cap {ENTRY_BYTES}')
        if info.compress_size and info.file_size > info.compress_size * EXPANSION:
            raise GuardError(f'entry "{info.filename}" expansion ratio {info.file_size}/{info.compress_size} exceeds max {EXPANSION}')
        total += info.file_size
        if total > limits.max_text_bytes:
            raise GuardError(f'cumulative declared payload exceeds EPUB_MAX_TEXT_BYTES={limits.max_text_bytes} (after entry "{info.filename}")')
    return len(infos), total
