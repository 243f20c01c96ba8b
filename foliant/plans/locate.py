"""Exact places of short texts in long ones, without comparing every pair.

Each item's needle is keyed by the hash of its first ``width`` characters; documents are scanned in Arrow batches by a
sliding hash of the same width against the set of keys, and hits are verified by comparison. The key set is collected
only after it was counted; above ``max_items`` the items go in parts of bounded size, one scan each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows


def locate(docs: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, width: int, max_items: int = 200_000) -> DataFrame:
    """doc, item, start: first place (in characters) of each item's first ``width`` characters in each text that has them."""
    needles = items.select(item_col, F.substring(text_col, 1, width).alias("needle")).where("needle <> ''")
    parts = int(needles.count() // max_items) + 1
    out = None
    for i in range(parts):
        chosen = needles if parts == 1 else needles.where(F.pmod(F.xxhash64(item_col), F.lit(parts)) == i)
        found = _scan(docs, [tuple(r) for r in chosen.collect()], doc_col, text_col, item_col)
        out = found if out is None else out.union(found)
    return out


def _scan(docs: DataFrame, needles: list[tuple], doc_col: str, text_col: str, item_col: str) -> DataFrame:
    by_head: dict[str, list[tuple]] = {}
    head = min((len(n) for _, n in needles), default=0)
    for item, needle in needles:
        by_head.setdefault(needle[:head], []).append((item, needle))

    def kernel(doc_id, words):
        if not words or not head:
            return
        seen = {words[i : i + head] for i in range(len(words) - head + 1)}
        for key in seen & by_head.keys():
            for item, needle in by_head[key]:
                at = words.find(needle)
                if at >= 0:
                    yield doc_id, item, at

    return map_rows(docs.select(doc_col, text_col), kernel, f"{doc_col} long, {item_col} long, start long")
