"""MT20: gradient-boosted trees on histograms, with missing values and balanced classes.

The model is fitted on at most SAMPLE labelled rows (those of the least hashes), in numpy; every row is then scored in
Arrow batches.  A feature's values fall into at most BINS bins and a bin of their own for missing ones; each node takes
the split of greatest gain over all features, bins and both ways for missing values; leaves hold Newton steps of the
logistic loss.  Classes weigh alike whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on, bins of a feature, trees, their depth, the rate, least rows and curvature of a leaf.
SAMPLE, BINS, ROUNDS, DEPTH, RATE, MIN_ROWS, MIN_CURVE = 20_000, 254, 200, 3, 0.05, 20, 1e-3


@dataclass
class Model:
    """Trees as heaps (the children of k are 2k + 1 and 2k + 2): feature (-1: a leaf), threshold, missing to the left,
    and value; ``start`` is the score before the first tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray


def cuts(x: np.ndarray) -> np.ndarray:
    """Upper bounds of all bins but the last: between neighbouring values, or quantiles where there are too many."""
    own = np.unique(x[~np.isnan(x)])
    if len(own) <= BINS:
        return (own[1:] + own[:-1]) / 2
    return np.unique(np.percentile(x[~np.isnan(x)], np.linspace(0, 100, BINS + 1)[1:-1], method="midpoint"))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int, int, bool]:
    """(gain, feature, last bin to the left, missing to the left) from sums of gradients, curvatures and rows by feature
    and bin; the last bin of each feature holds missing values.  Gain 0: no split."""
    best = (0.0, -1, -1, False)
    gs, hs, ns = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None], n.sum(axis=1)[:, None]
    for left in (False, True):
        gl, hl, nl = (np.cumsum(a[:, :-1], axis=1) + (a[:, -1:] if left else 0) for a in (g, h, n))
        ok = (nl >= MIN_ROWS) & (ns - nl >= MIN_ROWS) & (hl >= MIN_CURVE) & (hs - hl >= MIN_CURVE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, gl**2 / hl + (gs - gl) ** 2 / (hs - hl) - gs**2 / hs, 0)
        at = int(gain.argmax())
        if gain.flat[at] > best[0] + 1e-12:
            best = (float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1], left)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Model:
    """x: rows and features, NaN where missing; y: 0 or 1, both present."""
    n, d = x.shape
    edges = [cuts(x[:, k]) for k in range(d)]
    width = max((len(e) for e in edges), default=0) + 2
    bins = np.stack([np.where(np.isnan(x[:, k]), width - 1, np.searchsorted(edges[k], x[:, k], side="left")) for k in range(d)], axis=1)
    place = bins + np.arange(d) * width
    weight = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    share = (weight * y).sum() / weight.sum()
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    size = 2 ** (depth + 1) - 1
    model = Model(start, np.full((rounds, size), -1), np.zeros((rounds, size)), np.zeros((rounds, size), bool), np.zeros((rounds, size)))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            model.value[r, k] = -rate * g[rows].sum() / h[rows].sum() if h[rows].sum() > 0 else 0.0
            if k >= 2**depth - 1:
                continue
            flat = place[rows].ravel()
            sums = [np.bincount(flat, np.repeat(v, d), d * width).reshape(d, width) for v in (g[rows], h[rows], np.ones(len(rows)))]
            gain, f, b, left = best_split(*sums)
            if gain <= 0 or b >= len(edges[f]) + (0 if left else 1):
                continue
            # All values to the left leaves only missing ones on the right.
            model.feature[r, k], model.threshold[r, k], model.missing_left[r, k] = f, edges[f][b] if b < len(edges[f]) else np.inf, left
            go = np.where(bins[rows, f] == width - 1, left, bins[rows, f] <= b)
            node[rows] = np.where(go, 2 * k + 1, 2 * k + 2)
        score += model.value[r, node]
    return model


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Log-odds of class 1."""
    out = np.full(len(x), model.start)
    for r in range(len(model.feature)):
        node = np.zeros(len(x), np.int64)
        while (inner := model.feature[r, node] >= 0).any():
            v = x[np.arange(len(x)), np.maximum(model.feature[r, node], 0)]
            left = np.where(np.isnan(v), model.missing_left[r, node], v <= model.threshold[r, node])
            node = np.where(inner, np.where(left, 2 * node + 1, 2 * node + 2), node)
        out += model.value[r, node]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
    return flat.reshape(len(column), -1)


def train(rows: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """rows: id, x (array<double>, null where missing, all of one length), y (0 or 1, null rows are left out)."""
    own = rows.where("y is not null and x is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("x", "y").toArrow().combine_chunks()
    y = own.column("y").to_numpy().astype(float)
    if not (0 < y.sum() < len(y)):
        raise ValueError("both classes are needed")
    return fit(_matrix(own.column("x").combine_chunks()), y, rounds)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """id, score (log-odds), pred (1 where it is above 0)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = scores(sent.value, _matrix(b.column("x")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s > 0).astype(np.int32))], ["id", "score", "pred"])

    return rows.where("x is not null").select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, pred int")
