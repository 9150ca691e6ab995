"""Quality scores by support vectors on naive Bayes features.

A text's features are indicators of words, signs, shapes and their neighbouring pairs. Each is scaled by
the log ratio of its smoothed counts in good and poor texts, rows are brought to length one, and a linear model
with the hinge loss is fitted by dual coordinate descent. A logistic curve over the margins of rows left out
of that fit turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import FEATURE_BYTES, held_out, small_batches
from convoframe.llm.features import BITS, Rows, sampled_features, text_features, training_labels

# Most labelled rows that a fit takes.
LABELLED = 6_000


@dataclass
class NbSvm:
    """Scale and weight of each feature, and the curve from margins to probabilities."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    bits: int = BITS

    def margins(self, owner: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
        dot = np.bincount(owner, weights=(self.ratio * self.weights)[ids], minlength=rows)
        norm = np.sqrt(np.bincount(owner, weights=(self.ratio * self.ratio)[ids], minlength=rows))
        return dot / np.maximum(norm, 1e-12)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def log_count_ratio(rows: Rows, y: np.ndarray, size: int, alpha: float = 1.0, least: int = 3) -> np.ndarray:
    """Log ratio of smoothed feature shares in good (1) and poor (-1) rows; 0 for rare features."""
    good = y[rows.owner] > 0
    p = np.bincount(rows.ids[good], minlength=size)
    q = np.bincount(rows.ids[~good], minlength=size)
    r = np.log((alpha + p) / (alpha + p).sum()) - np.log((alpha + q) / (alpha + q).sum())
    return np.where(p + q >= least, r, 0.0)


def dual_descent(
    lists: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12
) -> np.ndarray:
    """Weights of the hinge-loss problem with row costs, by dual coordinate descent."""
    w = np.zeros(size)
    alpha = np.zeros(len(y))
    square = np.array([(v * v).sum() for v in values])
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(y)):
            if square[i] == 0:
                continue
            g = y[i] * (w[lists[i]] * values[i]).sum() - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w[lists[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def fit_curve(margins: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by damped Newton steps.

    Targets are pulled in from 0 and 1 by the class counts, so that separable margins stay finite.
    """
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = x @ (p - t)
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, cost: float = 1.0, bits: int = BITS) -> NbSvm:
    """A model from ``labels`` (doc_id, quality) outside the held-out fold, of ``limit`` rows at the most.

    A fifth of these rows is left out of the weights and fits the curve. With one class only, or without
    labels, every score is the share of good labels (one half without any).
    """
    size = 1 << bits
    got, rows = sampled_features(docs, training_labels(labels, "quality"), limit, bits, True)
    y = np.where(got == 1, 1.0, -1.0)
    apart = np.arange(len(y)) % 5 == 4
    fits, proves = np.flatnonzero(~apart), np.flatnonzero(apart)
    if len(set(y[fits].tolist())) < 2 or not len(proves):
        n1 = float((y > 0).sum())
        return NbSvm(np.zeros(size), np.zeros(size), 0.0, float(np.log((n1 + 1) / (len(y) - n1 + 1))), bits)
    every = list(rows)
    train = Rows.of([every[i] for i in fits])
    ratio = log_count_ratio(train, y[fits], size)
    lists = [x[ratio[x] != 0] for x in train]
    values = [ratio[x] / max(float(np.sqrt((ratio[x] ** 2).sum())), 1e-12) for x in lists]
    share = max((y[fits] > 0).mean(), 1e-3)
    costs = np.where(y[fits] > 0, cost * 0.5 / share, cost * 0.5 / max(1 - share, 1e-3))
    weights = dual_descent(lists, values, y[fits], size, costs)
    model = NbSvm(ratio, weights, 1.0, 0.0, bits)
    check = Rows.of([every[i] for i in proves])
    margins = model.margins(check.owner, check.ids, len(check))
    model.slope, model.offset = fit_curve(margins, y[proves] > 0)
    return model


def _scorer(model: NbSvm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text", FEATURE_BYTES):
                owner, ids = text_features(batch.column(1), model.bits, True)
                scores = model.scores(model.margins(owner, ids, batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """One row for each document row: doc_id, held_out, score (0 to 1, higher for likelier good), predicted.

    Null texts score as empty ones; null ids count as held out. Rows that repeat an id or a text are scored each;
    of several labels of one id, each counts. Texts may have any length: a batch holds a few MB of them, or one.
    Empty tables give an empty table. Other columns are not looked at, whatever their names.
    """
    model = fit_quality(docs, labels, **fit)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = source.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
