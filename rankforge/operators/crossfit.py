"""Cross-fitted, calibrated heads: no row is scored or calibrated by a model that saw it.

Rows lie in folds by a hash of their key.  One model a fold is trained on all other
rows, all of them together: rows are dealt over a fixed number of parts by another
hash, each part runs stochastic gradient descent over its rows in hash order, a row
stepping every model but its fold's, and after an epoch the parts' weights are
averaged by their rows.  So a part is one task's work whatever the folds, what moves
is the weights, and reruns agree on any cluster.  Scores of the models that did not
see a row are then calibrated by logistic fits of the score, again one a fold from
the other folds' rows, with Newton steps on sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scalar import order_digest, prefix_fold
from rankforge.operators.heads import array_sums, dense, fit_scaler, vectors
from rankforge.session import settle

#: Rows of a step, rows of a part at most about, parts at least.
BATCH, PART_ROWS, PARTS = 32, 200_000, 8


@dataclass
class CrossFit:
    #: (folds, features + 1), on standardised features, the intercept last.
    weights: np.ndarray
    #: (folds, 2): slope and intercept of the calibration.
    calibration: np.ndarray
    #: key, fold, y, raw (a logit), calibrated (a probability).
    rows: DataFrame


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _epoch(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weights: np.ndarray, rate: float, decay: float, balance: np.ndarray) -> np.ndarray:
    """The weights after one pass over a part's rows; a row doesn't move its own fold's model."""
    w = weights.copy()
    for at in range(0, len(x), BATCH):
        part, label = x[at : at + BATCH], y[at : at + BATCH]
        seen = fold[at : at + BATCH, None] != np.arange(len(w))
        error = (_sigmoid(part @ w.T) - label[:, None]) * balance[label.astype(int)][:, None] * seen
        w -= rate * (error.T @ part / np.maximum(seen.sum(0), 1)[:, None] + decay * w)
    return w


def cross_fit(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 5, epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 7, rounds: int = 25) -> CrossFit:
    """Class-balanced logistic heads; `key` names a row and decides its fold and its place."""
    name = F.col(key).cast("string")
    scaler, d = fit_scaler(df, features), len(features)
    rows = df.select(F.col(key).alias("key"), prefix_fold(name, folds).alias("fold"), F.col(label).cast("double").alias("y"), order_digest(name, seed).alias("place"), vectors([*scaler.columns(features), F.lit(1.0)]).alias("x"))
    rows = settle(rows.where(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull()))
    n, positives = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not positives or positives == n:
        raise ValueError("both classes are needed")
    balance = np.array([n / (2.0 * (n - positives)), n / (2.0 * positives)])
    parts = max(PARTS, -(-n // PART_ROWS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    weights = np.zeros((folds, d + 1))
    for epoch in range(epochs):
        run = _part_epoch(weights, rate / (1 + epoch), decay, balance)
        got = sorted(dealt.groupBy("part").applyInArrow(run, "part long, n long, w array<double>").collect())  # a row for each part
        weights = sum(r["n"] * np.array(r["w"]) for r in got).reshape(weights.shape) / n
    raw = settle(rows.mapInArrow(_scored(weights), f"key {rows.schema['key'].dataType.simpleString()}, fold int, y double, raw double"))
    calibration = _platt(raw, folds, rounds)
    values = [F.element_at(F.array(*[F.lit(float(v)) for v in calibration[:, k]]), F.col("fold") + 1) for k in (0, 1)]
    return CrossFit(weights, calibration, raw.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(values[0] * F.col("raw") + values[1])))))


def _part_epoch(weights: np.ndarray, rate: float, decay: float, balance: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        x = dense(group["x"].combine_chunks(), weights.shape[1])
        made = _epoch(x, group["y"].to_numpy(), group["fold"].to_numpy(), weights, rate, decay, balance)
        return pa.table({"part": group["part"][:1], "n": [len(x)], "w": pa.array([made.ravel()], pa.list_(pa.float64()))})

    return run


def _scored(weights: np.ndarray):
    """Each row's logit by the model of its own fold, which did not see it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            made = (dense(batch.column("x"), weights.shape[1]) * weights[fold]).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "fold", "y")), pa.array(made)], names=["key", "fold", "y", "raw"])

    return score


def _platt(raw: DataFrame, folds: int, rounds: int) -> np.ndarray:
    """Slope and intercept for each fold from the rows of the others; a slight penalty keeps separable scores finite."""
    now = np.tile([1.0, 0.0], (folds, 1))
    for _ in range(rounds):

        def parts(batch: pa.RecordBatch, now=now) -> Iterator[tuple[int, np.ndarray]]:
            fold, y, score = (batch.column(c).to_numpy() for c in ("fold", "y", "raw"))
            for k in range(folds):
                own = fold != k
                x = np.stack([score[own], np.ones(own.sum())], axis=1)
                p = _sigmoid(x @ now[k])
                yield k, np.concatenate([(x.T @ (x * np.maximum(p * (1 - p), 1e-12)[:, None])).ravel(), x.T @ (y[own] - p)])

        sums, moved = array_sums(raw.select("fold", "y", "raw"), parts), 0.0
        after = now.copy()
        for k, s in sums.items():
            step = np.linalg.solve(s[:4].reshape(2, 2) + 1e-3 * np.eye(2), s[4:] - 1e-3 * (now[k] - [1.0, 0.0]))
            after[k] += step
            moved = max(moved, np.abs(step).max())
        now = after
        if moved < 1e-9:
            break
    return now
