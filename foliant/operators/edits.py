"""Cleaning that keeps track of offsets: edit scripts as columns, and offsets mapped through them.

An edit is a struct (op, in_start, in_end, out_start, out_length); offsets are UTF-16 code units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import EditScript, clean, clean_around, from_units, moved, units
from ..plans.rows import map_rows

EDITS = "array<struct<op:string,in_start:int,in_end:int,out_start:int,out_length:int>>"
RANGES = "array<struct<start:int,end:int>>"
_FIELDS = ("op", "in_start", "in_end", "out_start", "out_length")


def _rows(script: EditScript) -> list[dict]:
    return [dict(zip(_FIELDS, e)) for e in script.edits]


def cleaned_with_script(docs: DataFrame, id_col: str, text_col: str, fix_breaks: bool = True) -> DataFrame:
    """id, text, edits, length_in, length_out: the cleaned text and how it came about. Null texts count as empty."""

    def kernel(doc_id, words):
        out, script = clean(units(words or ""), fix_breaks)
        yield doc_id, from_units(out), _rows(script), script.length_in, script.length_out

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), kernel, f"{id_col} {kind}, text string, edits {EDITS}, length_in int, length_out int")


def cleaned_around(docs: DataFrame, id_col: str, text_col: str, preserved_col: str) -> DataFrame:
    """id, text, preserved, edits, length_in, length_out: cleaned but for the preserved ranges, which follow the text."""

    def kernel(doc_id, words, ranges):
        kept = [(r["start"], r["end"]) for r in ranges or ()]
        out, script = clean_around(units(words or ""), kept)
        yield doc_id, from_units(out), [{"start": a, "end": b} for a, b in moved(kept, script)], _rows(script), script.length_in, script.length_out

    kind = dict(docs.dtypes)[id_col]
    return map_rows(
        docs.select(id_col, text_col, preserved_col), kernel, f"{id_col} {kind}, text string, preserved {RANGES}, edits {EDITS}, length_in int, length_out int"
    )


def output_end(edit: Column) -> Column:
    return edit["out_start"] + edit["out_length"]


def _holding(edits: Column, offset: Column) -> Column:
    return F.get(F.filter(edits, lambda e: (offset >= e["in_start"]) & (offset < e["in_end"])), F.lit(0))


def _in_bounds(offset: Column, length_in: Column, value: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("offset out of bounds: "), offset.cast("string"))).cast("int")
    return F.when(offset.between(0, length_in), value).otherwise(F.when(offset.isNotNull(), out))


def map_start(edits: Column, length_in: Column, length_out: Column, offset: Column) -> Column:
    """Where a range that starts at ``offset`` starts in the output: kept text shifts, replaced text gives its start,
    deleted text the next start that is left."""
    e = _holding(edits, offset)
    later = F.filter(edits, lambda x: (x["in_start"] > offset) & (x["op"] != "delete"))
    after = F.coalesce(F.get(later, F.lit(0))["out_start"], length_out)
    inside = F.when(e["op"] == "delete", after).when(e["op"] == "keep", e["out_start"] + offset - e["in_start"]).otherwise(e["out_start"])
    return _in_bounds(offset, length_in, F.when(offset == length_in, length_out).otherwise(inside))


def map_end(edits: Column, length_in: Column, length_out: Column, offset: Column) -> Column:
    """Where a range that ends before ``offset`` ends in the output."""
    e = _holding(edits, offset - 1)
    earlier = F.filter(edits, lambda x: (x["in_end"] < offset) & (x["op"] != "delete"))
    before = F.coalesce(output_end(F.element_at(F.when(F.size(earlier) > 0, earlier), -1)), F.lit(0))
    inside = F.when(e["op"] == "delete", before).when(e["op"] == "keep", e["out_start"] + offset - e["in_start"]).otherwise(output_end(e))
    return _in_bounds(offset, length_in, F.when(offset == 0, 0).when(offset == length_in, length_out).otherwise(inside))


def ranges_of(elements: Column, node_id: Column) -> Column:
    """Ranges of an element (structs node_id, tag, ranges); none if it has none."""
    hit = F.get(F.filter(elements, lambda e: e["node_id"] == node_id), F.lit(0))
    return F.coalesce(hit["ranges"], F.from_json(F.lit("[]"), RANGES))


def single_range_of(elements: Column, node_id: Column) -> Column:
    """The only range of an element; an error if it has none or several."""
    found = ranges_of(elements, node_id)
    bad = F.raise_error(F.lit("element has not exactly one range")).cast("struct<start:int,end:int>")
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(bad)
