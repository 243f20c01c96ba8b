"""Personal data: pattern spans, and terms whose corpus co-occurrence reveals the protected values.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct value is a protected entity. A
term reveals an entity by their pointwise mutual information over whole documents, as a share of the entity's own
information: log(n_ct * N / (n_c * n_t)) / log(N / n_c), 1 where the term never occurs without the entity. In
documents that hold the entity, terms above a threshold are generalised to their shape and terms above a higher one
removed, wherever they stand. All of it is DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text

#: Kinds in order, and their patterns. Possessive runs and look-behinds leave the matches of the plain patterns as
#: they are, and keep the search linear: a run of a class that failed at its start fails at all later starts too.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_PARTS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


@dataclass(frozen=True)
class Disclosure:
    """support: documents in which entity and term must meet; generalise, remove: shares of the entity's information;
    broadcast_terms, broadcast_bytes: above either, term counts are joined by key; least: characters of a term, as shorter ones name nobody."""

    support: int = 2
    generalise: float = 0.8
    remove: float = 0.95
    broadcast_terms: int = 200_000
    broadcast_bytes: int = 16 << 20
    least: int = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def place(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    places = F.transform(F.sequence(F.lit(1), F.length(digits)), place)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP_PARTS)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda m: _valid(kind, m["value"])


def _placed(pieces: Column, found: Column, order: int, kind: str) -> Column:
    """Matches with their places: what stands before the i-th match is the i-th piece of the text split by the pattern."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,value:string>>)")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        grown = F.concat(s["out"], F.array(F.struct(start.alias("start"), x["value"].alias("value"))))
        return F.struct((start + F.length(x["value"])).alias("at"), grown.alias("out"))

    placed = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.transform(
        placed,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")
        ),
    )


def _matched(df: DataFrame, pattern: Column, order: int, kind: str, where: Column) -> DataFrame:
    """``df`` with column ``kind``: the matches of ``pattern`` in ``text``, empty where ``where`` is false."""
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string,value:string>>)")
    df = df.withColumn("_found", F.when(where, F.regexp_extract_all("text", pattern, F.lit(0))))
    df = df.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("text", pattern, -1)))
    return df.withColumn(kind, F.when(F.size("_found") > 0, _placed(F.col("_pieces"), F.col("_found"), order, kind)).otherwise(none)).drop("_found", "_pieces")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), and for each kind its valid matches, in the text's order."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    hints = {"email": F.col("text").contains("@"), "ip": F.col("text").contains("."), "card": F.lit(True), "phone": F.col("text").contains("+")}
    for order, (kind, pattern) in enumerate(KINDS.items()):
        df = _matched(df, F.lit(pattern), order, kind, hints[kind])
        df = df.withColumn(kind, F.filter(kind, _validity(kind)))
    return df


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def _holders(found: DataFrame) -> DataFrame:
    """(row, entity), each once a row: the entities of the row's base spans."""

    def entity(m: Column) -> Column:
        return F.concat_ws(":", m["kind"], F.when(m["kind"].isin("card", "phone"), _digits(m["value"])).otherwise(F.lower(m["value"])))

    return found.select("row", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))


def _terms(text: Column, least: int) -> Column:
    """The distinct terms of a whole text: runs of letters and digits, of ``least`` characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]{{{least},}}+"), F.lit(0)))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str, how: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) for terms whose share of an entity's information reaches ``how.generalise``, and the
    (row, entity, term) that they may be in: the terms of whole documents.

    A term is in no fewer documents than it shares with the entity, so a share of g needs n_t <= N * (n_c / N) ^ g;
    terms of more documents are left out before they are paired.
    """
    total = float(docs.count())
    holders = _holders(found)
    n_c = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).where((F.col("n_c") >= how.support) & (F.col("n_c") < total))
    most = F.lit(total) * F.pow(F.col("n_c") / F.lit(max(total, 1.0)), F.lit(how.generalise)) * (1 + 1e-9)
    holders = materialise(holders.join(n_c.withColumn("most", most), "entity"))
    limit = holders.agg(F.max("most")).first()[0] or 0.0
    standing = found.join(holders.select("row").distinct(), "row", "left_semi").select("row", F.explode(_terms(F.col("text"), how.least)).alias("term"))
    terms = materialise(standing.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(how.support, limit)).select("term"))
    words = docs.select(F.explode(_terms(whole_text(text_col), how.least)).alias("term"))
    n_terms, size = terms.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if n_terms <= how.broadcast_terms and (size or 0) <= how.broadcast_bytes:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t").between(how.support, limit))
    standing = materialise(standing.join(n_t, "term"))
    pairs = holders.join(standing, "row").where(F.col("n_t") <= F.col("most"))
    meet = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t")).where(F.col("n_ct") >= how.support)
    information = F.log2(F.lit(total) / F.col("n_c"))
    share = F.log2(F.col("n_ct") * F.lit(total) / (F.col("n_c") * F.col("n_t"))) / information
    reveal = materialise(meet.select("entity", "term", share.alias("share")).where(F.col("share") >= how.generalise))
    return reveal, pairs.select("row", "entity", "term")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Disclosure = Disclosure()) -> DataFrame:
    """Return doc_id, text, base, terms, sanitised: one row per row of ``docs``.

    base and terms are arrays of (start, order, end, kind, value), sorted, in code points, ends exclusive; terms have
    the kind 'generalise' or 'remove' and don't overlap base spans. sanitised is the text with base spans replaced by
    their kind, and terms by their shape or by nothing. Null and empty texts have no spans; repeated rows are documents
    of their own, also in the counts; texts of any length are searched whole; null ids stay null. Empty table: empty
    result. Other columns are not read.
    """
    scanned = base_spans(docs, id_col, text_col)
    every = F.concat(*KINDS)
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string,value:string>>)")
    clean = scanned.where(F.size(every) == 0).select("doc_id", "text", none.alias("base"), none.alias("terms"), F.col("text").alias("sanitised"))
    held = scanned.where(F.size(every) > 0).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.array_sort(every).alias("base"))
    held = materialise(held)
    reveal, pairs = disclosing_terms(docs, held, text_col, how)
    of_row = pairs.join(reveal, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    of_row = of_row.groupBy("row").agg(
        F.collect_list(F.when(F.col("share") < how.remove, F.col("term"))).alias("mild"), F.collect_list(F.when(F.col("share") >= how.remove, F.col("term"))).alias("strong")
    )
    df = held.join(of_row, "row", "left")
    for order, (kind, column) in enumerate((("generalise", "mild"), ("remove", "strong")), start=len(KINDS)):
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(column), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        df = _matched(df, pattern, order, kind, F.size(column) > 0)
    apart = F.filter(F.concat("generalise", "remove"), lambda t: ~F.exists("base", lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"])))
    df = df.select("doc_id", "text", "base", F.array_sort(apart).alias("terms"))
    return clean.union(df.select("doc_id", "text", "base", "terms", _sanitised(F.col("text"), F.array_sort(F.concat("base", "terms"))).alias("sanitised")))


def _sanitised(text: Column, spans: Column) -> Column:
    def shape(m: Column) -> Column:
        word = F.when(m["value"].rlike(r"^\p{N}+$"), "[NUMBER]").when(m["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(m["kind"] == "remove", "").when(m["kind"] == "generalise", word).otherwise(F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")))

    def step(s: Column, m: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(m["start"] - s["at"], F.lit(0)))
        put = F.when(m["start"] >= s["at"], shape(m)).otherwise("")
        return F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.concat(s["out"], F.array(F.concat(gap, put))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def finish(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))

    return F.aggregate(spans, start, step, finish)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Disclosure = Disclosure()) -> DataFrame:
    """Return doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms from ``pii_spans``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii_spans(docs, id_col, text_col, how).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
