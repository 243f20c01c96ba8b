"""License scans by conditional compression.

A text's words are laid out in windows, for each template of a width that holds any place where the template can stand.
Each window is compressed with the template as a zstandard raw dictionary; templates are ranked by what they save against
compression without one, and the winners are confirmed by the exact differences of wording. Windows cover whole texts,
whatever their lines and comment marks. A window is left uncompressed only if it provably can't be confirmed: if it has no
three words in a row of the template, or fewer of the template's words than the least share needs. SPDX tags name their
licenses themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property
from itertools import repeat
from math import ceil

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, whole_text
from .license_texts import NOTICES, TEXTS, whole_texts

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Words that tell notices apart: a difference in one of them rejects a template.
_TELLING = re.compile(r"v?[0-9.]+\Z|(?:MIT|Apache|GNU|General|Lesser|Affero|BSD|Mozilla|CC|CC0|Unlicense)\Z|(?:BY|Attribution)(?:-|\Z)|.*-Clause\Z|proprietary\Z", re.I)
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*\Z")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")
#: Words in a row that a confirmed place shares with its template at the least.
_FIRM = 3
#: Words up to which a template is a notice, and beyond which it is a whole text that its title and opening tell apart.
_NOTICE, _LONG, _OPENING = 25, 400, 40
#: Characters between a license's title or copyright line and its text, at the most.
_NEAR = 200

Found = tuple[str, int, int, float, str]


def all_templates() -> dict[str, tuple[str, ...]]:
    """Notices, headers, short licenses and whole license texts, by SPDX identifier."""
    kinds = (NOTICES, TEXTS, whole_texts())
    return {name: sum((k.get(name, ()) for k in kinds), ()) for name in dict.fromkeys(n for k in kinds for n in k)}


def _codes(ids: np.ndarray, base: int) -> np.ndarray:
    """A number for each three words in a row; 0 where one of them is in no template."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    return np.where((a > 0) & (b > 0) & (c > 0), (a * base + b) * base + c, 0)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``known``."""
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def _packer(**given: object) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **given)


class _Template:
    """One wording of a license, with what scanning for it needs."""

    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, [w.lower() for w in _WORD.findall(text)]
        self.raw = " ".join(self.words).encode()
        n = len(self.words)
        #: By the least share, a place has this many words in common at the least and spans so many at the most.
        self.common, self.step, self.width = ceil(n * least / (2 - least) - 1e-9), n, n + ceil(n * (2 / least - 1))
        self.telling = {w for w in self.words if _TELLING.match(w)}

    def numbered(self, vocabulary: dict[str, int]) -> None:
        ids = np.array([vocabulary[w] for w in self.words], dtype=np.int64)
        self.ids, self.counts = np.unique(ids, return_counts=True)
        self.codes = np.unique(_codes(ids, len(vocabulary) + 1))

    @cached_property
    def packer(self) -> zstandard.ZstdCompressor:
        return _packer(dict_data=zstandard.ZstdCompressionDict(self.raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def windows(self, hits: np.ndarray, n: int) -> list[int]:
        """Starts of the windows that hold one of the hits whole, in a text of ``n`` words."""
        last = hits // self.step
        first = np.maximum(0, -((self.width - _FIRM - hits) // self.step))
        out: set[int] = set()
        for a, b in set(zip(first.tolist(), last.tolist())):
            out.update(range(a, b + 1))
        return [k * self.step for k in sorted(out) if k * self.step < n]


class Scanner:
    """Templates, their numbered words and compressors, made once a task."""

    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.8, gain: float = 0.4):
        self.least, self.gain, self.plain = least, gain, _packer()
        given = all_templates() if templates is None else templates
        self.templates = [_Template(name, text, least) for name, texts in given.items() for text in texts]
        if any(len(t.words) < _FIRM for t in self.templates):
            raise ValueError(f"a template has {_FIRM} words at the least")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.templates for w in t.words}), 1)}
        for t in self.templates:
            t.numbered(self.vocabulary)
            t.own = len(self.plain.compress(t.raw))
        self.codes = np.unique(np.concatenate([t.codes for t in self.templates])) if self.templates else np.zeros(0, np.int64)

    def scan(self, text: str, every: bool = False) -> list[Found]:
        """(license, start, end, share, differences) for each place of the text that a template explains.

        With ``every``, all windows are compressed with all templates; the result is the same.
        """
        out = [found for m in _SPDX.finditer(text) for found in _tagged(m)]
        taken = sorted({f[1:3] for f in out})  # disjoint, so their ends are in order too
        for found in self.places(text, every):
            at = bisect_left(taken, found[1:3])
            if (at == 0 or taken[at - 1][1] <= found[1]) and (at == len(taken) or found[2] <= taken[at][0]):
                taken.insert(at, found[1:3])
                out.append(found)
        out.sort(key=lambda f: (f[1], f[2], f[0]))
        starts = [f[1] for f in out]
        followers = ((f, out[bisect_left(starts, f[2]) : bisect_right(starts, f[2] + _NEAR)]) for f in out)
        return [f for f, after in followers if not any(_heads(f, o) for o in after)]

    def places(self, text: str, every: bool) -> list[Found]:
        """Confirmed places, those of the greatest savings first."""
        words = _WORD.findall(text)
        if len(words) < _FIRM:
            return []
        lower = " ".join(words).lower().split(" ")
        ids = np.fromiter(map(self.vocabulary.get, lower, repeat(0)), dtype=np.int64, count=len(lower))
        codes = _codes(ids, len(self.vocabulary) + 1)
        some = np.flatnonzero(codes)
        hits = some[_among(codes[some], self.codes)]
        if not every and not len(hits):
            return []
        of_text = np.bincount(ids, minlength=len(self.vocabulary) + 1)
        found = []
        for t in self.templates:
            if every:
                starts = list(range(0, len(words), t.step))
            elif np.minimum(of_text[t.ids], t.counts).sum() < t.common:
                continue
            else:
                starts = t.windows(hits[_among(codes[hits], t.codes)], len(words))
            for start in starts:
                if every or np.minimum(np.bincount(ids[start : start + t.width], minlength=len(of_text))[t.ids], t.counts).sum() >= t.common:
                    if got := self.confirmed(t, lower[start : start + t.width]):
                        saved, first, last, same, share, differences = got
                        found.append((-saved, -same * share, t.name, start + first, start + last, share, differences))
        if not found:
            return []
        spots = [m.span() for m in _WORD.finditer(text)]
        return [(name, spots[first][0], spots[last - 1][1], share, differences) for _, _, name, first, last, share, differences in sorted(found)]

    def confirmed(self, t: _Template, words: list[str]) -> tuple[int, int, int, int, float, str] | None:
        """(bytes saved, first word, last word, words in common, share, differing words) if compression with the template
        saves enough of the window or of the template, and the wording bears it out."""
        raw = " ".join(words).encode()
        alone = len(self.plain.compress(raw))
        saved = alone - len(t.packer.compress(raw))
        if saved < self.gain * min(alone, t.own):
            return None
        codes = SequenceMatcher(None, t.words, words, autojunk=False).get_opcodes()
        firm = [i for i, (op, a, b, _, _) in enumerate(codes) if op == "equal" and b - a >= _FIRM]
        before = np.cumsum([0] + [b - a if op == "equal" else 0 for op, a, b, _, _ in codes])
        best = max(
            ((2 * int(before[j + 1] - before[i]) / (len(t.words) + codes[j][4] - codes[i][3]), j - i, -i, i, j) for x, i in enumerate(firm) for j in firm[x:]),
            default=None,
        )
        if best is None or best[0] < self.least:
            return None
        share, (i, j) = best[0], best[3:]
        first, last, kept = codes[i][3], codes[j][4], codes[i : j + 1]
        missing = t.words[: codes[i][1]] + [w for op, a, b, _, _ in kept if op != "equal" for w in t.words[a:b]] + t.words[codes[j][2] :]
        added = [w for op, _, _, c, d in kept if op != "equal" for w in words[c:d]]
        if self.wrong(t, words[first:last], missing, added):
            return None
        return saved, first, last, int(before[j + 1] - before[i]), share, " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in added])

    def wrong(self, t: _Template, words: list[str], missing: list[str], added: list[str]) -> bool:
        """Whether the differences are such as make another license of it."""
        if len(t.words) > _LONG:
            return bool(_kinds(words[:_OPENING]) - _kinds(t.words[: 2 * _OPENING]))
        notice = len(t.words) <= _NOTICE and any(_TELLING.match(w) for w in missing + added)
        return notice or _kinds(t.words) != _kinds(words)


def _kinds(words: list[str]) -> set[str]:
    """What tells the texts of a family apart: the word before 'General', and version numbers."""
    pairs = list(zip(words, words[1:]))
    return {a for a, b in pairs if b == "general"} | {b for a, b in pairs if a in ("version", "v") and _NUMBER.match(b)}


def _tagged(m: re.Match) -> Iterator[Found]:
    """The licenses of an SPDX tag, exceptions left out, each once; 'or later' and 'only' count as the version itself."""
    names = re.findall(r"(?<![\w.+-])(?<!WITH )(?!(?:AND|OR|WITH)\b)[A-Za-z0-9][A-Za-z0-9.+-]*", m[1].split("  ")[0])
    operators = re.findall(r"\b(?:AND|OR|WITH)\b", m[1])
    names = names if operators else names[:1]
    for name in dict.fromkeys(re.sub(r"(?:-only|-or-later|\+)$", "", n) for n in names):
        yield name, m.start(), m.start() + len(m[0].rstrip()), 1.0, ""


def _heads(notice: Found, text: Found) -> bool:
    """The notice is the title or the copyright line of the license text that follows it."""
    return notice[0] in (text[0], "Proprietary") and notice[2] - notice[1] < text[2] - text[1]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Return doc_id, license, start, end, share, differences: one row per place found, in one pass without an exchange.

    Offsets are in code points. Of overlapping places the one that saves most stays; of equal savings the one with most
    words in common, then the first license by name, then the first place. Null and empty texts give no rows; repeated rows
    repeat theirs; very long texts are searched whole. Null ids stay null. Empty table: empty result. Other columns are not
    read. Without ``templates``, those of ``all_templates`` are taken.
    """
    given = all_templates() if templates is None else templates

    def run(rows: list[tuple], scanner: Scanner) -> Iterator[tuple]:
        for doc_id, text in rows:
            for found in scanner.scan(text):
                yield doc_id, *found

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(texts, run, "doc_id long, license string, start long, end long, share double, differences string", lambda: Scanner(given))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Return doc_id, n_blocks, licenses (sorted, comma-joined, '' if none), spans: one row per row of ``docs``.

    Cases as in ``license_scan``; rows without a license, null and empty texts among them, have 0 and empty strings.
    """
    given = all_templates() if templates is None else templates

    def run(rows: list[tuple], scanner: Scanner) -> Iterator[tuple]:
        for doc_id, text in rows:
            found = scanner.scan(text)
            yield doc_id, len(found), ",".join(sorted({f[0] for f in found})), ",".join(f"{f[0]}:{f[1]}:{f[2]}" for f in found)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(texts, run, "doc_id long, n_blocks long, licenses string, spans string", lambda: Scanner(given))
