"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts and texts without labels are what the model sees. With the class prior p, the
loss of an unlabelled text taken for clean is an average over p toxic and 1 - p clean texts; taking the
toxic share away leaves the risk on clean texts, which may not fall below zero. When it does, a step goes the
other way, so that the model does not fit the sample's toxic texts as clean ones. A text's features are
indicators of its words, their beginnings and inner runs of letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import FEATURE_BYTES, U64, held_out, mix, small_batches, split_words
from convoframe.llm.features import (
    BITS,
    Rows,
    distinct_per_row,
    sampled_features,
    spread,
    training_labels,
    word_grams,
)

# Most rows that a fit takes: confirmed toxic texts, and texts without labels.
POSITIVES = 3_000
UNLABELLED = 9_000


@dataclass
class LinearModel:
    """Weights of the features that count, and a bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.ids] = self.weights
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu(
    positive: Rows,
    unlabelled: Rows,
    size: int,
    prior: float,
    steps: int = 400,
    rate: float = 0.1,
    decay: float = 1e-4,
    beta: float = 0.0,
    gamma: float = 1.0,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the sigmoid loss, by Adam.

    The loss is bounded: an unbounded one would let far-off toxic texts outweigh the clean ones.
    """
    w = np.zeros(size + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)

    def grad(rows: Rows, slope: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(size + 1)
        out[:size] = np.bincount(rows.ids, weights=slope[rows.owner], minlength=size)
        out[size] = slope.sum()
        return out / n

    for step in range(1, steps + 1):
        zp = positive.dot(w[:size]) + w[size]
        zu = unlabelled.dot(w[:size]) + w[size]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        clean_risk = su.mean() - prior * sp.mean()
        toxic_grad = prior * grad(positive, sp * (1 - sp), n_p)
        clean_grad = grad(unlabelled, su * (1 - su), n_u) - toxic_grad
        if clean_risk >= -beta:
            g = clean_grad - toxic_grad
        else:
            g = -gamma * clean_grad
        g[:size] += decay * w[:size]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    least_z: float = 4.0,
    bits: int = BITS,
) -> LinearModel:
    """A model from ``labels`` (doc_id, toxic) outside the held-out fold and from unlabelled ``docs``.

    The class prior is the toxic share of those labels. Features are kept whose shares among toxic and
    unlabelled texts differ by ``least_z`` standard errors. Without toxic labels or texts every score is 0.
    """
    known = training_labels(labels, "toxic")
    share = known.agg(F.avg("label")).first()[0] or 0.0
    _, p_rows = sampled_features(docs, known.where("label = 1"), positives, bits, False)
    anyone = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("label")
    )
    _, u_rows = sampled_features(docs, anyone, unlabelled, bits, False)
    if not len(p_rows) or not len(u_rows):
        return LinearModel(np.zeros(0, dtype=np.int64), np.zeros(0), -30.0, bits)
    prior = min(max(share, 1e-3), 0.5)
    size = 1 << bits
    cp, cu = p_rows.counts(size), u_rows.counts(size)
    pool = (cp + cu + 1) / (len(p_rows) + len(u_rows) + 2)
    error = np.sqrt(pool * (1 - pool) * (1 / len(p_rows) + 1 / len(u_rows)))
    z = np.abs(cp / len(p_rows) - cu / len(u_rows)) / error
    ids = np.flatnonzero((z >= least_z) & (cp + cu >= 5))
    place = np.full(size, -1, dtype=np.int32)
    place[ids] = np.arange(len(ids))
    compact = [rows.only(place) for rows in (p_rows, u_rows)]
    weights, bias = nn_pu(*compact, len(ids), prior)
    return LinearModel(ids, weights, bias, bits)


def _scorer(model: LinearModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        known = dense != 0
        for whole in batches:
            for batch in small_batches([whole], "text", FEATURE_BYTES):
                offsets, codes, words = split_words(batch.column(1), lower=False)
                starts, low = word_grams(words)
                ids = (mix(low) >> U64(64 - model.bits)).astype(np.int64)
                # Only chunks with a feature that counts are looked up in the texts.
                counts = np.concatenate([[0], np.cumsum(known[ids])])
                useful = (counts[starts[1:]] > counts[starts[:-1]])[codes]
                rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[useful]
                owner, at = spread(codes[useful], starts)
                rows, values = distinct_per_row(rows[owner], ids[at])
                z = np.bincount(rows, weights=dense[values], minlength=batch.num_rows) + model.bias
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z))], names=["key", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: LinearModel, key: str = "doc_id") -> DataFrame:
    """(``key``, score): 0 to 1, higher for likelier toxic. Null texts score as empty ones."""
    kind = dict(docs.dtypes)[key]
    scored = docs.select(F.col(key).alias("key"), "text").mapInArrow(_scorer(model), f"key {kind}, score double")
    return scored.withColumnRenamed("key", key)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """One row for each document row: doc_id, held_out, score, predicted.

    Null texts score as empty ones; null ids count as held out. Rows that repeat an id or a text are scored each;
    of several labels of one id, each counts. Texts may have any length: a batch holds a few MB of them, or one.
    Empty tables give an empty table. Other columns are not looked at, whatever their names.
    """
    model = fit_toxicity(docs, labels, **fit)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return toxicity_scores(source, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
