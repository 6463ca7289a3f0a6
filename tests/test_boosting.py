"""Boosted trees against a version that tries every split of every node by hand."""

import numpy as np
import pytest

from latticework.operators import boosting as b


def data(n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3) > 0.8).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 3] = np.where(y == 1, np.where(rng.random(n) < 0.6, np.nan, 0.5), x[:, 3])  # missing says something
    return x, y


def brute(x, y, rounds, depth, rate):
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    score = np.full(n, np.log((w * y).sum() / (w * (1 - y)).sum()))

    def grow(rows, g, h, level, out):
        best = (1e-12, None)
        if level < depth:
            for left in (False, True):
                for f in range(x.shape[1]):
                    for c in [*b.cuts(x[:, f]), np.inf]:
                        go = np.where(np.isnan(x[rows, f]), left, x[rows, f] <= c)
                        a, z = rows[go], rows[~go]
                        if min(len(a), len(z)) < b.MIN_ROWS or min(h[a].sum(), h[z].sum()) < b.MIN_CURVE:
                            continue
                        gain = g[a].sum() ** 2 / h[a].sum() + g[z].sum() ** 2 / h[z].sum() - g[rows].sum() ** 2 / h[rows].sum()
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, z))
        if best[1] is None:
            out[rows] = -rate * g[rows].sum() / h[rows].sum()
        else:
            for part in best[1]:
                grow(part, g, h, level + 1, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(n)
        grow(np.arange(n), w * (p - y), w * p * (1 - p), 0, step)
        score = score + step
    return score


def test_fit_is_the_exhaustive_search():
    x, y = data()
    model = b.fit(x, y, rounds=6)
    np.testing.assert_allclose(b.scores(model, x), brute(x, y, 6, 3, b.RATE), atol=1e-8)


def test_many_values_and_learning():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] ** 2 + x[:, 1] > 1).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    model = b.fit(x[:2000], y[:2000], rounds=60)
    assert len(b.cuts(x[:, 0])) <= b.BINS and ((b.scores(model, x[2000:]) > 0) == y[2000:]).mean() > 0.85


def test_train_and_predict(spark):
    x, y = data(200)
    rows = [(k, [None if np.isnan(v) else float(v) for v in r], int(t), "x") for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1, "x"), (901, [0.0] * 4, None, "x")], "id long, x array<double>, y int, score string").repartition(3)
    model = b.train(df, rounds=5)
    got = {r.id: r for r in b.predict(df, model).collect()}
    assert set(got) == {*range(200), 901} and all(r.pred == (r.score > 0) for r in got.values())
    np.testing.assert_allclose([got[k].score for k in range(200)], b.scores(b.fit(x, y, 5), x), atol=1e-8)  # the order of rows does not matter
    with pytest.raises(ValueError, match="both classes"):
        b.train(df.where("y = 1"))
