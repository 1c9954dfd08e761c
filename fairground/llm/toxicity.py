"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import by_value
from .common import bounded_batches, materialize, release_freed
from .labels import training_rows, with_score

#: Labelled rows that a model is fitted on at most, and distinct n-grams of all of them (4 bytes each on the driver).
MOST_ROWS, MOST_GRAMS = 3_000, 16_000_000
#: n-gram lengths, bits of a feature's number.
SHORTEST, LONGEST, BITS = 3, 5, 20
SMOOTH, RIDGE, STEPS, IN_TEXTS = 1.0, 1e-2, 40, 2
#: Characters hashed at once.
AT_ONCE = 1 << 20
by_value(__name__)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of the character n-grams of a whole text in lower case, with repeats, piece by piece."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for start in range(0, max(1, len(points) - LONGEST + 1), AT_ONCE):
        piece = points[start : start + AT_ONCE + LONGEST - 1]
        rolled, found = piece * np.uint32(2654435761), []
        for n in range(2, LONGEST + 1):
            if len(piece) < n:
                break
            rolled = rolled[:-1] * np.uint32(1540483477) + piece[n - 1 :] * np.uint32(2246822519)
            if n >= SHORTEST:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(739982445)
                found.append(mixed >> np.uint32(32 - BITS))
        if found:
            yield np.concatenate(found)


class Distinct:
    """The distinct feature numbers of one text after another, without sorting."""

    def __init__(self) -> None:
        self.place = np.zeros(1 << BITS, np.int32)
        self.text = np.full(1 << BITS, -1, np.int32)
        self.count = 0

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        self.count = (self.count + 1) % (1 << 30)
        for found in grams(text):
            order = np.arange(len(found), dtype=np.int32)
            self.place[found] = order
            last = found[self.place[found] == order]
            new = last[self.text[last] != self.count]
            self.text[new] = self.count
            yield new


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        distinct = Distinct()
        z = np.array([self.bias + sum(float(self.weights[new].sum(dtype=np.float64)) for new in distinct(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimize(value, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking. value(x) gives the loss and its gradient."""
    x, (loss, slope), past = start, value(start), []
    for _ in range(steps):
        turn, rates = slope.copy(), []
        for s, y, r in reversed(past):
            rates.append(r * (s @ turn))
            turn -= rates[-1] * y
        if past:
            s, y, _ = past[-1]
            turn *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(rates), strict=True):
            turn += (a - r * (y @ turn)) * s
        down, size = slope @ turn, 1.0 if past else 1 / max(1.0, float(np.abs(slope).sum()))
        for _ in range(25):
            to = x - size * turn
            there, steep = value(to)
            if there <= loss - 1e-4 * size * down:
                break
            size /= 2
        else:
            return x
        s, y = to - x, steep - slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        done = loss - there < 1e-6 * max(1.0, abs(loss))
        x, loss, slope = to, there, steep
        if done:
            break
    return x


def fit_rows(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, smooth: float = SMOOTH, ridge: float = RIDGE, steps: int = STEPS, in_texts: int = IN_TEXTS) -> ToxicityModel:
    """rows: distinct feature numbers of each text; the list is emptied on the way. Features of fewer than
    in_texts of these texts get no weight."""
    size = 1 << BITS
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if not rows or not 0 < share < 1:
        return ToxicityModel(np.zeros(size, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    times = np.zeros(size, np.int32)
    for r in rows:
        times[r] += 1
    used = np.flatnonzero(times >= in_texts)
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    # Only these features stay, as 32-bit numbers in one array: a few bytes for each of them and text.
    ends = np.cumsum([np.count_nonzero(number[r] >= 0) for r in rows])
    n, flat = len(ends), np.empty(int(ends[-1]), np.int32)
    for i, r in enumerate(rows):
        kept, rows[i] = number[r], None
        flat[int(ends[i - 1]) if i else 0 : int(ends[i])] = kept[kept >= 0]
    del r
    rows.clear()

    def by_feature(of_text: np.ndarray) -> np.ndarray:
        """The sum of a number of each text over the texts that have each feature, a few texts at a time."""
        out = np.zeros(len(used))
        for a in range(0, n, 256):
            cut = slice(int(ends[a - 1]) if a else 0, int(ends[min(n, a + 256) - 1]))
            sizes = np.diff(ends[a : a + 256], prepend=cut.start)
            out += np.bincount(flat[cut], weights=np.repeat(of_text[a : a + 256], sizes), minlength=len(used))
        return out

    def by_text(of_feature: np.ndarray) -> np.ndarray:
        """The sum of a number of each feature over the features that each text has."""
        sums = np.zeros(n)
        for a in range(0, n, 256):
            start, stop = int(ends[a - 1]) if a else 0, int(ends[min(n, a + 256) - 1])
            total = np.concatenate([[0.0], np.cumsum(of_feature[flat[start:stop]])])
            at = np.concatenate([[0], ends[a : a + 256] - start])
            sums[a : a + 256] = total[at[1:]] - total[at[:-1]]
        return sums

    hits, misses = by_feature(weight * y) + smooth, by_feature(weight * (1 - y)) + smooth
    ratio = np.log(hits / hits.sum()) - np.log(misses / misses.sum())

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[-1] + by_text(ratio * x[:-1])
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum()
        off = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / weight.sum()
        slope = np.append(ratio * by_feature(off) + ridge * x[:-1], off.sum())
        return loss + ridge / 2 * (x[:-1] @ x[:-1]), slope

    start = np.zeros(len(used) + 1)
    start[-1] = np.log(share / (1 - share))
    found = minimize(value, start, steps)
    weights = np.zeros(size, np.float32)
    weights[used] = ratio * found[:-1]
    return ToxicityModel(weights, float(found[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS, most_grams: int = MOST_GRAMS, in_texts: int = IN_TEXTS) -> ToxicityModel:
    """Learn label 1 from at most `most` labelled rows, half of each label, none of them held out.

    Executors turn whole texts into distinct feature numbers and store them. The driver gets those of the
    rows taken and fits the weights, so its memory is bounded by bytes too: a row with more than most_grams / 2
    numbers is never taken; of the others of a label, in the order of a hash, those are taken that together have
    most_grams / 2 numbers or fewer, and the first that would go beyond ends the sample of its label. Without
    labelled rows every score is 0.5."""
    bounded_batches(docs.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for batch in batches:
            found = [np.concatenate([*distinct(t), np.zeros(0, np.uint32)]).astype("<u4").tobytes() for t in batch.column(0).to_pylist()]
            sizes = [len(f) // 4 for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sizes, pa.int64()), *batch.columns[1:]], names=["grams", "size", "y", "weight", "order"])

    rows = training_rows(docs, labels, label, most, balanced=True).select("text", "y", "weight", F.xxhash64("id").alias("order"))
    rows = materialize(rows.mapInArrow(number, "grams binary, size long, y int, weight double, order long"), "grams").where(F.col("size") <= most_grams // 2)
    taken = F.sum("size").over(Window.partitionBy("y").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = rows.select("y", "order", "size").withColumn("sum", taken).where(F.col("sum") <= most_grams // 2)  # `most` narrow rows
    last = {r["y"]: (r["order"], r["n"]) for r in sizes.groupBy("y").agg(F.max("order").alias("order"), F.count("*").alias("n")).collect()}
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for y, (order, _) in last.items():
        chosen = chosen | ((F.col("y") == y) & (F.col("order") <= order))
    found = rows.where(chosen).select("grams", "y", "weight").toArrow()
    texts = [np.frombuffer(g.as_buffer(), "<u4") for g in found.column("grams")]
    y = found.column("y").to_numpy().astype(float)
    weight = found.column("weight").to_numpy() * np.array([totals[k] / last[k][1] for k in y.astype(int)])
    del found
    model = fit_rows(texts, y, weight, in_texts=in_texts)
    release_freed()
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "score", text_col: str = "text") -> DataFrame:
    """docs and its toxicity, 0 to 1, of each whole text; empty and null texts are scored as empty."""
    return with_score(docs, model, out, text_col)
