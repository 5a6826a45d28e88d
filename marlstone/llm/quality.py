"""Document quality by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import id_hash, materialize

STATISTICS = ("symbols", "exclamations", "bars", "capitals", "digits", "stops", "adjacent repeats", "distinct words", "words", "word length", "lines")
#: Shares are damped as if a text had so many more bytes (words), so a short text is no outlier for one sign.
DAMP = 40
#: Weight of the pooled covariance in each class's, and then of the mean variance on the diagonal.
POOL, RIDGE = 0.10, 0.002
#: Labelled ids up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Where a text is held against label 1.
THRESHOLD = 0.3


def statistics(text: bytes | None) -> tuple[float, ...]:
    """Transformed statistics of a UTF-8 text; null counts as empty."""
    text = text or b""
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text) + DAMP
    small, capital, digit, other = int(c[97:123].sum()), int(c[65:91].sum()), int(c[48:58].sum()), int(c[128:].sum())
    stops = int(c[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    blank = int(c[9:14].sum() + c[32])
    symbols = len(text) - small - capital - digit - other - stops - blank
    words = text.lower().split()
    n = len(words)
    repeats, distinct = sum(map(eq, words, words[1:])), len(set(words))
    root = math.sqrt
    return (
        root((symbols - int(c[124])) / size),
        root(int(c[33]) / size),
        root(int(c[124]) / size),
        root(capital / (small + capital + other + DAMP)),
        root(digit / size),
        root(stops / size),
        root(repeats / (n + DAMP / 8)),
        math.log((distinct + 5) / (n + 5)),
        math.log(n + 5),
        math.log((len(text) - blank + DAMP) / (n + DAMP / 5)),
        root(int(c[10]) / size),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the statistics, of every row, repeated ones too; null and empty texts have those of no characters, an empty table no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """By class 0 and 1: mean, inverse Cholesky factor of the covariance, log of prior over root determinant."""

    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    bias: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the Mahalanobis log-densities."""
        density = [self.bias[k] - 0.5 * np.square((x - self.mean[k]) @ self.whiten[k].T).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame) -> Model | None:
    """A model from all rows of ``x, label``; None if a class has no row.

    Tasks sum counts, vectors and outer products, and their sums are added up by place, so the driver gets a few hundred numbers in all.
    """
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x, y = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, d), b.column(1).to_numpy()
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                first[k] += part.sum(0)
                second[k] += part.T @ part
        every = np.concatenate([n, first.ravel(), second.ravel()])
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(every)], ["i", "s"])

    total = np.zeros(2 + 2 * d + 2 * d * d)
    for r in labelled.select("x", "label").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r["i"]] = r["s"]
    if not total[:2].all():
        return None
    n, first, second = total[:2], total[2 : 2 + 2 * d].reshape(2, d), total[2 + 2 * d :].reshape(2, d, d)
    mean = [first[k] / n[k] for k in (0, 1)]
    cov = [second[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    overall = first.sum(0) / n.sum()
    pooled = second.sum(0) / n.sum() - np.outer(overall, overall)
    whiten, bias = [], []
    for k in (0, 1):
        own = (1 - POOL) * cov[k] + POOL * pooled
        own = (1 - RIDGE) * own + RIDGE * np.eye(d) * np.trace(own) / d + 1e-9 * np.eye(d)
        chol = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(chol))
        bias.append(math.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum())
    return Model(mean, whiten, bias)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    labels: ``doc_id, quality`` (1 good, 0 not). Rows with crc32(doc_id as text) mod 5 = 0 are
    held out of learning. Labels that are null or not 0 or 1 teach nothing; of an id labelled
    more than once the smallest label counts. Null texts are empty ones and get a score like
    any; if a class has no row to learn from, every score is 1. Texts are read whole, however
    long. Repeated rows get a row each, an empty table none; other columns are not read.
    """
    ship(docs.sparkSession)
    x = materialize(features(docs, id_col, text_col), "statistics")
    held_out = id_hash("doc_id") % 5 == 0
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    model = fit(x.where(~held_out).join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATISTICS)
        for b in batches:
            rows = np.array(b.column(2).to_pylist(), np.float64).reshape(-1, d)
            score = model.score(rows) if model else np.ones(len(rows))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns as they are.

    The model is fitted first; then one pass scores and filters whole rows, so no text is shuffled.
    Null texts are scored as empty ones; repeated rows stay or go together; without a class to
    learn from every row stays; an empty table stays empty. Columns of any names are carried along.
    """
    ship(docs.sparkSession)
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    teaching = docs.where(id_hash(id_col) % 5 != 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if known.count() <= BROADCAST_ROWS:  # 8 bytes each; texts without a label are then not even measured
        teaching = teaching.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    x = features(teaching)
    model = fit(materialize(x, "statistics").join(known, "doc_id"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model:
                x = np.array([statistics(t.as_py()) for t in b.column(at).cast(pa.binary())]).reshape(-1, len(STATISTICS))
                b = b.filter(pa.array(model.score(x) >= threshold))
            yield b

    return docs.mapInArrow(run, docs.schema)

