"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-cased characters, each present or not. Fitting takes a sample
of labelled rows of bounded size; scoring takes every whole text, in one pass without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, whole_text

#: The factors of the n-gram hash (odd, from the golden ratio), one for each place.
_FACTORS = np.array([(0x9E3779B1 * (2 * k + 1)) & 0xFFFFFFFF for k in range(1, 17)], dtype=np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class FitLimits:
    """Bounds of the fitting sample: rows a class, and bytes of a row (longer rows are not fitted on; all are scored)."""

    positives: int = 2000
    negatives: int = 6000
    row_bytes: int = 16_384


class Toxicity:
    """place: of each hashed n-gram among the kept ones, or -1; weights: of the kept n-grams, counted once if present;
    bias: the log-odds of a text without any."""

    def __init__(self, place: np.ndarray, weights: np.ndarray, bias: float, sizes: tuple[int, ...], bits: int):
        self.place, self.weights, self.bias, self.sizes, self.bits = place, weights, bias, sizes, bits
        self._seen = np.zeros(len(weights) + 1, dtype=bool)

    def __reduce__(self):
        return Toxicity, (self.place, self.weights, self.bias, self.sizes, self.bits)

    def score(self, text: str) -> float:
        seen = self._seen
        for h in hashed(text, self.sizes, self.bits):
            seen[self.place[h]] = True  # the last place is that of all others
        seen[-1] = False
        total = self.bias + float(self.weights[seen[:-1]].sum())
        seen[:] = False
        return 1 / (1 + float(np.exp(-np.clip(total, -40, 40))))


def hashed(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The hashes (below 2**bits) of all n-grams of the lower-cased text between two spaces, size by size."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint32)
    with np.errstate(over="ignore"):
        h = np.zeros(len(raw), dtype=np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(raw) < n:
                return
            h = h[: len(raw) - n + 1]
            h = (h + raw[n - 1 :]) * _FACTORS[n]
            h ^= h >> np.uint32(15)
            if n in sizes:
                yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def present(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The features present in ``text``, ascending."""
    parts = list(hashed(text, sizes, bits))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)


def fit_texts(
    texts: list[str], toxic: list[int], sizes: tuple[int, ...] = (4, 6, 8), bits: int = 20, keep: int = 8_000, l2: float = 1.0, rounds: int = 250
) -> Toxicity:
    """Fit on texts in memory: log-count ratios, the ``keep`` n-grams of largest ratio, then a logistic regression."""
    y = np.array(toxic, dtype=np.float64)
    width = 1 << bits
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 2)  # without any label: not toxic
        return Toxicity(np.full(width, -1, dtype=np.int32), np.zeros(0, dtype=np.float32), float(np.log(prior / (1 - prior))), sizes, bits)
    counts = np.zeros((2, width), dtype=np.float32)
    for text, label in zip(texts, toxic):
        counts[label, present(text, sizes, bits)] += 1
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * width)
    ratio = np.log(share[1] / share[0])
    # The ratio less two standard errors ranks n-grams, so that those seen once or twice come last.
    error = np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5))
    order = np.argsort(-(np.abs(ratio) - 2 * error), kind="stable")[:keep]
    place = np.full(width, -1, dtype=np.int32)
    place[order] = np.arange(len(order))
    scale = ratio[order].astype(np.float32)
    # Features are hashed again rather than held: the kept ones are few, all of them would fill the driver.
    cols = []
    for text in texts:
        own = place[present(text, sizes, bits)]
        cols.append(own[own >= 0])
    lengths = list(map(len, cols))
    col = np.concatenate(cols)
    del cols, share, error, counts
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    value = scale[col]
    w, b = np.zeros(len(order)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, steps = np.zeros(len(order) + 1), np.zeros(len(order) + 1), rounds
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(row, weights=value * w[col], minlength=len(texts))
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(col, weights=value * g[row], minlength=len(order)) + l2 * w, g.sum()) / len(texts)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Toxicity(place, (w * scale).astype(np.float32), float(b), sizes, bits)


def held_out(id_col: str = "doc_id"):
    """True for rows whose label is never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limits: FitLimits = FitLimits()) -> Toxicity:
    """Fit on at most ``limits`` labelled rows, those whose id's hash is lowest; rows of ``held_out`` ids never count.

    Labels other than 0 and 1, null ids and null texts are left out; ties of the hash are broken by id and text. The sample, at most
    (positives + negatives) x row_bytes, is all that reaches the driver; the rest of the labels isn't moved.
    """
    picked = []
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull())
    known = known.where(~held_out("doc_id"))
    for label, most in ((1, limits.positives), (0, limits.negatives)):
        picked.append(known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    chosen = picked[0].union(picked[1]).dropDuplicates(["doc_id"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= limits.row_bytes)
    sample = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(limits.positives + limits.negatives)
    rows = sample.select("text", "toxic").collect()
    return fit_texts([r[0] for r in rows], [r[1] for r in rows])


def toxicity_scores(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null texts score as empty ones do: the bias alone decides. Null ids have a null ``held_out``. Texts of any length
    are scored whole; repeated rows repeat. Other columns, lang and source among them, are not read. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(rows: list[tuple], fitted: Toxicity) -> Iterator[tuple]:
        for doc_id, text in rows:
            score = fitted.score(text)
            yield doc_id, score, int(score >= 0.5)

    scored = map_texts(texts, run, "doc_id long, score double, predicted int", lambda: shared.value)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns; cases as in ``toxicity_scores``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clean = F.udf(lambda text: shared.value.score(text or "") < 0.5, "boolean", useArrow=True)
    return docs.where(clean(F.col(text_col).cast("string")))
