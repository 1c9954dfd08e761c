"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import by_value
from .common import bounded_batches, materialize
from .labels import training_rows, with_score

#: Labelled rows that a model is fitted on at most, Fourier features, ridge, and partitions that sum.
MOST_ROWS, FEATURES, RIDGE, SUMMERS, CALIBRATION_FOLD = 20_000, 256, 1e-3, 8, 3
LOWER, UPPER, DIGIT, SPACE, POINT, SYMBOL = range(6)
POINTS = ".,;:'\"-?()¿¡«»"
RUNS = re.compile(r"([^\w\s])\1+")
by_value(__name__)


def _classes() -> np.ndarray:
    """The class of each code point below 0x250, and of all others (as lower-case letters) at the end."""
    kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "No": DIGIT, "Zs": SPACE, "Cc": SPACE}
    of = lambda c: POINT if c in POINTS else kinds.get(unicodedata.category(c), LOWER if unicodedata.category(c)[0] in "LM" else SYMBOL)
    return np.array([*(of(chr(i)) for i in range(0x250)), LOWER], dtype=np.uint8)


CLASSES = _classes()


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; an empty or null one has zeros throughout."""
    text = text or ""
    words = text.split()
    if not words:
        return np.zeros(16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(CLASSES[np.minimum(points, len(CLASSES) - 1)], minlength=6)
    n, letters, black = len(words), max(1, kinds[LOWER] + kinds[UPPER]), max(1, len(points) - kinds[SPACE])
    lines = [x for x in text.split("\n") if x.strip()]
    marks = text.count("!")
    pairs = len(set(zip(words, words[1:], strict=False)))
    return np.array([
        np.log1p(n),
        black / n,
        kinds[UPPER] / letters,
        kinds[DIGIT] / black,
        kinds[POINT] / black,
        kinds[SYMBOL] / black,
        np.log1p(len(RUNS.findall(text)) / n * 20),
        np.log1p((text.count("|") + text.count("<") + text.count("{")) / n * 20),
        np.log1p(marks / n * 20),
        len(set(words)) / n,
        np.log(len(set(words))) / np.log(n + 1),
        sum(map(str.__eq__, words, words[1:])) / n,
        (pairs + 1) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        letters / black,
    ])


def pool_adjacent(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: the score at which each level begins, rising, and its share of label 1."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        if blocks and blocks[-1][0] == x:
            blocks[-1][1] += y
            blocks[-1][2] += 1
        else:
            blocks.append([x, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, y, n = blocks.pop()
            blocks[-1][1] += y
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class QualityModel:
    """mean, scale: of the statistics; waves, phases: the random features; weights: the ridge fit; knots, levels: the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """The random Fourier features, the standard statistics and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.waves + self.phases) * np.sqrt(2 / len(self.phases)), x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Between levels by a line, and by a hair by the raw score itself, so equal levels still rank."""
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.calibrated(self.raw(np.array([statistics(t) for t in texts]).reshape(-1, 16)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> QualityModel:
    """Learn label 1 from at most `most` labelled rows, none of them held out.

    The fold CALIBRATION_FOLD of these gives the isotonic levels, the others the normal equations. Each of
    SUMMERS partitions sums its own equations, and the driver adds SUMMERS matrices. Without labelled rows
    (empty tables) every score is 0.5; with one label only, it is near that label."""
    bounded_batches(docs.sparkSession)
    rng = np.random.default_rng(seed)
    n = 16
    model = QualityModel(np.zeros(n), np.ones(n), rng.normal(size=(n, features)) / np.sqrt(n), rng.uniform(0, 2 * np.pi, features), np.zeros(features + n + 1), np.array([0.0]), np.array([0.5]))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["stats", "y", "fold"])

    rows = training_rows(docs, labels, label, most).select("text", "y", "fold")
    rows = materialize(rows.mapInArrow(describe, "stats array<double>, y int, fold int"), "quality").coalesce(SUMMERS)
    fit, calibrate = rows.where(F.col("fold") != CALIBRATION_FOLD), rows.where(F.col("fold") == CALIBRATION_FOLD)
    moments = fit.agg(F.count("*"), F.array(*[F.avg(F.get("stats", F.lit(i))) for i in range(n)]), F.array(*[F.coalesce(F.stddev(F.get("stats", F.lit(i))), F.lit(0.0)) for i in range(n)])).first()
    if not moments[0]:
        return model
    model.mean, scale = np.array(moments[1]), np.array(moments[2])
    model.scale = np.where(scale > 1e-9, scale, 1.0)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = features + n + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, n))
            total += z.T @ np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    sums = sum(np.frombuffer(r[0]).reshape(features + n + 1, -1) for r in fit.select("stats", "y").mapInArrow(equations, "sums binary").collect())
    model.weights = np.linalg.solve(sums[:, :-1] + ridge * moments[0] * np.eye(len(sums)), sums[:, -1])
    held = calibrate.select("stats", "y").collect() or fit.select("stats", "y").collect()
    model.knots, model.levels = pool_adjacent(model.raw(np.array([r[0] for r in held])), np.array([r[1] for r in held], dtype=float))
    return model


def with_quality(docs: DataFrame, model: QualityModel, out: str = "score", text_col: str = "text") -> DataFrame:
    """docs and its quality, 0 to 1, of each whole text; empty and null texts are scored as empty."""
    return with_score(docs, model, out, text_col)
