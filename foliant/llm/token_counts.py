"""Edit-aware token counts.

A document's pre-tokens and their token counts sit in blocks under a segment tree whose nodes sum characters and
tokens. An edit re-splits the text from the last pre-token that can't have seen it until a pre-token boundary falls on
an old one again, encodes only what is new, and updates the sums on the paths of the blocks it touched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import map_texts, whole_text

#: Characters past its end that a match of the pre-token pattern may have looked at: "'" followed by two letters.
_SEEN = 2


class TokenTree:
    """Token counts of one text under edits. reencoded: pre-tokens encoded since the tree was made."""

    def __init__(self, text: str, codec: Codec, block: int = 128):
        self.codec, self.block, self.reencoded = codec, block, 0
        tokens = codec.split(text)
        self._build(tokens, codec.counts(tokens))

    def _build(self, tokens: list[str], counts: list[int]) -> None:
        starts = range(0, len(tokens), self.block) or [0]
        self.blocks = [tokens[i : i + self.block] for i in starts]
        self.counts = [counts[i : i + self.block] for i in starts]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (part, each) in enumerate(zip(self.blocks, self.counts)):
            self.chars[self.size + i], self.tokens[self.size + i] = len("".join(part)), sum(each)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(b) for b in self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at``, and the characters before that block; the last block for the end."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters start..end (clamped to the text) by ``replacement``."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, before = self._find(max(0, start - _SEEN))
        while True:  # the boundary B with B + _SEEN <= start, else the start of the text
            ends = list(accumulate(map(len, self.blocks[first]), initial=before))
            keep = max((i for i, e in enumerate(ends) if e + _SEEN <= start), default=0)
            if ends[keep] + _SEEN <= start or first == 0:
                break
            first -= 1
            before -= self.chars[self.size + first]
        begin = ends[keep]
        old = self.blocks[first][keep:]  # pre-tokens from ``begin`` on, as far as they are looked at
        last = first
        ahead = 8
        while True:
            bounds = list(accumulate(map(len, old), initial=begin))
            past = bisect_left(bounds, end)
            while last + 1 < len(self.blocks) and len(old) < past + ahead:
                last += 1
                old += self.blocks[last]
                bounds = list(accumulate(map(len, old), initial=begin))
                past = bisect_left(bounds, end)
            whole = last + 1 == len(self.blocks) and len(old) <= past + ahead
            shown = "".join(old[: len(old) if whole else past + ahead])
            new_text = shown[: start - begin] + replacement + shown[end - begin :]
            shift = start + len(replacement) - end
            at, fresh, met = begin, [], None
            places = {b: i for i, b in enumerate(bounds)}
            for token in self.codec.split(new_text):
                if at >= start + len(replacement) and at - shift in places and at - shift >= end:
                    met = places[at - shift]
                    break
                if not whole and at + len(token) + _SEEN > begin + len(new_text):
                    break
                fresh.append(token)
                at += len(token)
            else:
                met = len(old) if whole else None
            if met is not None:
                break
            ahead *= 2
        self.reencoded += len(fresh)
        known = [n for i in range(first, last + 1) for n in self.counts[i]]  # a kept pre-token keeps its count
        self.blocks[first] = self.blocks[first][:keep] + fresh + old[met:]
        self.counts[first] = known[:keep] + self.codec.counts(fresh) + known[keep + met :]
        for i in range(first + 1, last + 1):
            self.blocks[i], self.counts[i] = [], []
        if len(self.blocks[first]) > 8 * self.block:
            self._build([t for b in self.blocks for t in b], [n for b in self.counts for n in b])
            return
        for i in range(first, last + 1):
            node = self.size + i
            self.chars[node], self.tokens[node] = len("".join(self.blocks[i])), sum(self.counts[i])
            while node > 1:
                node //= 2
                self._sum(node)


def edited_counts(docs: DataFrame, edits: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_tokens, n_tokens_after, n_pre_tokens, n_edits, n_reencoded: one row per row of ``docs``.

    ``edits``: array of (start, end, replacement) over the row, applied one after the other, each to the text that the
    one before left; places are code points and clamped to the text; null edits, and null fields of one, count as
    none. Null and empty texts have no tokens until an edit adds some. Repeated rows repeat; very long texts are
    counted whole. One pass, no exchange. Empty table: empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec.from_file(path))

    def run(rows: list[tuple], codec: Codec) -> Iterator[tuple]:
        for doc_id, text, changes in rows:
            tree = TokenTree(text, codec)
            n, pre, done = tree.n_tokens, sum(map(len, tree.blocks)), 0
            for change in changes or ():
                if change and None not in (change["start"], change["end"], change["replacement"]):
                    tree.edit(change["start"], change["end"], change["replacement"])
                    done += 1
            yield doc_id, n, tree.n_tokens, pre, done, tree.reencoded

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), edits.alias("edits"))
    schema = "doc_id long, n_tokens long, n_tokens_after long, n_pre_tokens long, n_edits long, n_reencoded long"
    return map_texts(rows, run, schema, lambda: shared.value)


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits a row, placed by the id's hash: a word put in, 20 characters cut, the first word replaced."""
    n = F.length(whole_text(text_col)).cast("long")
    place = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), n + 1)

    def edit(start: Column, end: Column, new: str) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("replacement"))

    return F.array(edit(place, place, " inserted words, 42"), edit(n - place, n - place + 20, ""), edit(F.lit(0).cast("long"), F.lit(5).cast("long"), "Edited"))
