"""Training: gradients against differences, a loss that falls, and runs that go on after a loss."""

import numpy as np
import pytest

from latticework.operators import training

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = []
    for k in range(90):
        positive = k % 3 == 0
        v = RNG.normal(size=6)
        v[0] = (0.7 if positive else -0.7) + RNG.normal() * 0.5  # what tells them apart, beside five numbers of noise
        rows.append((k, v.tolist(), "positive" if positive else "negative", k % 4 + 1, k % 5 == 0))
    return spark.createDataFrame(rows, "id long, v array<double>, label string, tier int, held boolean").repartition(3)


def test_gradient(vectors):
    w = training.start(3, 6, 1)
    rows = training._with_vectors(training.mine(training.project(vectors.select("id", "v", "label"), w)), vectors).cache()
    gradient, loss, val = training.sums(rows, w)
    data = rows.collect()
    direct = [r.w * max(0, 0.2 + np.linalg.norm(w @ (np.array(r.va) - r.vp)) - np.linalg.norm(w @ (np.array(r.va) - r.vn))) for r in data]
    for held, got in ((False, loss), (True, val)):
        assert got == pytest.approx(sum(d for d, r in zip(direct, data, strict=True) if r.held == held) / sum(r.w for r in data if r.held == held))
    for i, j in ((0, 0), (2, 5), (1, 3)):
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        assert gradient[i, j] == pytest.approx((training.sums(rows, w + e)[1] - training.sums(rows, w - e)[1]) / 2e-6, abs=1e-5)
    rows.unpersist()


def test_loss_falls_and_a_restart_goes_on(vectors, tmp_path):
    whole = training.train(vectors, str(tmp_path / "whole"), 7, embed=3, rate=0.5)
    losses = [r.train_loss for r in whole.orderBy("epoch").collect()]
    assert len(losses) == 7 and losses[2] < losses[0] and losses[5] < losses[3]  # under the same triplets
    import math

    real = training.sums
    calls = []

    def lost(*a):
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("lost")
        return real(*a)

    training.sums = lost
    try:
        with pytest.raises(RuntimeError):
            training.train(vectors, str(tmp_path / "parts"), 7, embed=3, rate=0.5)
    finally:
        training.sums = real
    again = training.train(vectors, str(tmp_path / "parts"), 7, embed=3, rate=0.5)
    one, two = ({r.epoch: r for r in run.collect()} for run in (whole, again))
    assert set(one) == set(two) == set(range(7))
    for k in one:
        np.testing.assert_allclose(one[k].w, two[k].w, atol=1e-9)
        assert math.isclose(one[k].val_loss, two[k].val_loss, abs_tol=1e-9)
    epoch, w = training.best(whole)
    assert one[epoch].val_loss == min(r.val_loss for k, r in one.items() if k) and (w.ravel() == one[epoch - 1].w).all()
