"""Ordinal quality classifier on hashed text.

Cumulative links: ``P(grade >= k) = sigmoid(w . x - theta_k)`` with one weight
vector for all grades and ordered thresholds ``theta_1 < theta_2 < ...``, so the
scores of different grades never cross.  ``x`` is the text's byte trigrams and
marks of its form (repeated lines, length, capitals, symbols) hashed into
``DIM`` buckets, square-rooted and scaled to length 1.

The model is fitted on at most ``max_rows`` labelled documents, those with the
smallest hash of their id; the bound is a parameter and keeps the driver's
memory fixed.  A quarter of them, not fitted on, calibrates the cut: the tail
probability below which at most ``false_reject`` of the good texts fall.

Cases: null and empty texts have the marks of an empty text and are scored;
null ids are scored, never fitted on; repeated labels of an id count by their
lowest grade; without two grades to learn from every text is kept with
probability 1; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

DIM = 2048
#: Labelled rows that the model is fitted and calibrated on, at most.
MAX_ROWS = 4000


def _mark(name: int, level: int) -> int:
    return (name * 40503 + level * 9973 + 1013904223) * 2654435761 % (1 << 32) >> 21


def _level(share: float) -> int:
    return int(min(1.0, share) * 10 + 0.5)


def features(text: bytes) -> np.ndarray:
    """The hashed, scaled features of one text."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        gram = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        gram ^= gram >> np.uint32(15)
        x = np.bincount((gram * np.uint32(0x2C1B3C6D)) >> np.uint32(21), minlength=DIM).astype(np.float32)
        x /= len(gram)
    else:
        x = np.zeros(DIM, np.float32)
    lines = [s for s in text.split(b"\n") if s]
    letters = max(1, int(((b | 32) - 97 < 26).sum()))
    capitals = int((b - 65 < 26).sum())
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    words = text.count(b" ") + len(lines)
    marks = [
        (1, _level(1 - len(set(lines)) / max(1, len(lines)))),
        (2, len(text).bit_length()),
        (3, _level(capitals / letters)),
        (4, _level(4 * symbols / max(1, len(text)))),
        (5, _level(text.count(b"!") / max(1, words))),
        (6, min(20, len(text) // max(1, words))),
    ]
    for name, level in marks:
        x[_mark(name, level)] += 0.02
    x = np.sqrt(x)
    return x / max(1e-6, float(np.sqrt((x * x).sum())))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def tails(self, x: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1, 2, ...; one row per text."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -40, 40)))


def fit(x: np.ndarray, grade: np.ndarray, steps: int = 300, rate: float = 0.3, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps with running moments.

    The thresholds are a first one plus exponentials, so they stay in order.
    """
    levels = int(grade.max())
    above = (grade[:, None] >= np.arange(1, levels + 1)[None, :]).astype(np.float32)
    share = np.clip(above.mean(0), 0.01, 0.99)
    start = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(0.05, np.diff(start)))]).astype(np.float64)
    d, m, v = x.shape[1], 0.0, 0.0
    # Every grade weighs the same, however rare.
    counts = np.bincount(grade, minlength=levels + 1)
    weight = (len(grade) / np.maximum(1, counts) / (counts > 0).sum())[grade]
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        prob = 1 / (1 + np.exp(-np.clip((x @ p[:d].astype(np.float32))[:, None] - theta[None, :], -40, 40)))
        error = (prob - above) * weight[:, None] / len(x)
        g_theta = -error.sum(0)
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([x.T @ error.sum(1).astype(np.float32) + ridge * p[:d], later[:1], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def default_grade() -> Column:
    """Grades 0 to 2 from the label columns: low quality, good but toxic, good."""
    return F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, max_rows: int = MAX_ROWS, false_reject: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on a bounded sample of labelled documents; None without two grades."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("_lid"), (grade if grade is not None else default_grade()).cast("int").alias("_grade"))
    sample = graded.groupBy("_lid").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], ["id", "grade", "x"])

    # The sample has max_rows ids at most, so it can be broadcast; of texts that repeat an id the least one counts.
    held = _util.id_text(docs, id_col, text_col).join(F.broadcast(sample), F.col("_id") == F.col("_lid")).groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_grade").alias("_grade"))
    rows = held.select("_id", "_text", "_grade").mapInArrow(run, "id long, grade int, x binary").toPandas()
    if rows.empty or rows["grade"].nunique() < 2:
        return None
    rows = rows.sort_values("id")
    x = np.stack([np.frombuffer(r, np.float16) for r in rows["x"]]).astype(np.float32)
    grades = rows["grade"].to_numpy(np.int64)
    turn = np.arange(len(rows)) % 4 == 3
    if len(np.unique(grades[~turn])) < 2 or not (grades[turn] > 0).any():
        turn = np.zeros(len(rows), bool)
    weights, thresholds = fit(x[~turn], grades[~turn])
    model = Model(weights.astype(np.float32), thresholds, 0.0)
    test = turn if turn.any() else ~turn
    good = np.sort(model.tails(x[test])[:, 0][grades[test] > 0])
    model.cut = float(min(0.5, good[int(false_reject * len(good))] - 1e-6))
    return model


def judge(model: Model | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tail probabilities of each text, and whether it is kept."""
    if model is None:
        tails = np.ones((len(texts), 1))
    else:
        tails = np.concatenate([np.zeros((0, len(model.thresholds))), *[model.tails(features(t)[None, :]) for t in texts]])
    return tails, tails[:, 0] >= (model.cut if model else 0.0)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` of every whole text; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, kept = judge(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1).astype(np.float64)), pa.array(tails[:, 0].astype(np.float64)), pa.array(kept)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return _util.id_text(docs, id_col, text_col).mapInArrow(_util.releasing(run), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    _util.tune(docs.sparkSession)
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose text isn't rejected, and those without an id; they are scored and filtered in one pass."""
    _util.tune(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return _util.keep_rows(docs, lambda texts: judge(model, texts)[1], id_col, text_col)
