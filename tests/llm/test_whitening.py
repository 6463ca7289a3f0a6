"""Whitening against a brute-force version with Python's whole numbers and numpy's covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from latticework.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, v string, n long, component int, deviation string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "x", "v", 1, 2, "d") for k, v in vectors], SCHEMA).repartition(3)


def brute(vectors, count=4):
    keep = [(k, [math.floor(256 * np.float64(np.float32(c))) for c in v]) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in keep})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[n * x[j] - s[j] for j in range(d)] for x in fit], object)
    v = np.array([[float(Fraction(int((z[:, i] * z[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:count], w.T[::-1][:count]
    w = [u * np.sign(u[np.argmax(np.abs(u))]) for u in w]
    out = []
    for k, x in keep:
        c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        out += [(k, j + 1, n, dev if dev < 2**63 else None, float(c @ w[j]) / math.sqrt(e[j]), e[j] / np.trace(v)) for j in range(len(e))]
    return out


def same(df, vectors):
    got = df.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    left, right = sorted([(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got], key=key), sorted(brute(vectors), key=key)
    assert [r[:4] for r in left] == [r[:4] for r in right]
    np.testing.assert_allclose([r[4] for r in left], [r[4] for r in right], rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose([r[5] for r in left], [r[5] for r in right], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(whitening.op11_whitening(spark, sf_dir), rows)


@pytest.mark.parametrize("width", [1, 6])
def test_awkward_vectors(spark, width):
    rng = random.Random(width)
    good = [(k, [rng.gauss(j, 1 + j) for j in range(width)]) for k in range(80)]
    good += [(7, good[0][1]), (7, good[0][1]), (None, good[3][1]), (None, good[4][1])]  # repeats, and rows without an id
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [None] * width), (902, [nan] * width), (903, [inf] * width), (904, [-inf] * width), (905, [1.0] * (width + 1)), (906, [])]
    same(whitening.whiten(frame(spark, good + bad)), good)


def test_long_sums_are_exact(spark):
    rng = random.Random(5)
    big = [(k, [rng.choice([-1, 1]) * 2.0**40 * rng.random(), rng.gauss(0, 2.0**41), rng.gauss(0, 2.0**39)]) for k in range(300)]
    same(whitening.whiten(frame(spark, big)), big)
    huge = [(k, [rng.gauss(0, 2.0**50), rng.gauss(0, 2.0**52)]) for k in range(50)]
    same(whitening.whiten(frame(spark, huge)), huge)


def test_squares_and_digits():
    rng = np.random.default_rng(1)
    y = rng.integers(-(2**62), 2**62, (500, 7))
    assert whitening.squares(y) == [sum(int(v) ** 2 for v in c) for c in y.T]
    assert whitening.squares(y.astype(object)) == whitening.squares(y)
    for v in (0, -1, 2**200 + 17, -(2**199) - 3):
        row = whitening._numbers({(0, 0): v}).to_pylist()[0]
        assert sum(row[f"d{k}"] << 40 * k for k in range(7)) == v


def test_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == whitening.whiten(frame(spark, [(1, None)])).count() == 0
    alike = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(alike) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alike} == {(1, 0, 0.0, 0.0, 1.0)}
