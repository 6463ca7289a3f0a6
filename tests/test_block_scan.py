"""The search by blocks: against brute force, and what it writes and asks."""

import os

import numpy as np
import pytest

from latticework.operators import block_scan, metric_index, training
from latticework.operators import neighbours as nn


def brute(ids, v, above, k, leave_self, rid, rv):
    out = []
    for n in range(len(ids)):
        d = np.sqrt(((rv - v[n]) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((rid, d)) if not (leave_self and rid[j] == ids[n]) and (above is None or d[j] > above[n])]
        out += [(n, int(rid[j]), float(d[j])) for j in near[:k]]
    return out


@pytest.mark.parametrize("factor,offset", [(1.0, 0.0), (1e-3, 1e6), (1e25, 0.0), (1e19, 0.0), (1e-17, 0.0), (1e-30, 0.0)])
def test_scan(factor, offset):
    """Also where single precision has too little room, or none."""
    rng = np.random.default_rng(4)
    for t in range(60):
        width, n, m = int(rng.integers(1, 20)), int(rng.integers(0, 40)), int(rng.integers(0, 120))
        draw = (lambda *s: rng.integers(0, 3, s).astype(float)) if t % 2 else (lambda *s: rng.normal(size=s))  # every second one has ties
        v, rv = (draw(x, width) * factor + offset for x in (n, m))
        ids, rid = rng.permutation(n).astype(np.int64), rng.permutation(m).astype(np.int64)
        above, k, step = (None if t % 3 else rng.uniform(-1, 3, n) * factor), int(rng.integers(1, 8)), int(rng.integers(1, 50))
        blocks = [(rid[i : i + step], rv[i : i + step]) for i in range(0, m, step)]
        got = block_scan.scan(ids, v, above, k, t % 4 < 2, blocks)
        assert [(int(a), int(b), float(d)) for a, b, d in zip(*got, strict=True)] == brute(ids, v, above, k, t % 4 < 2, rid, rv)


@pytest.mark.parametrize("name", ["references", "few queries"])
def test_large_sides_are_not_copied(spark, monkeypatch, name):
    """where all directions are alike every query met every cell of the index, as a written copy of its vector."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    queries = frame if name == "references" else frame.where("id < 40")
    n = 1500 if name == "references" else 40
    monkeypatch.setattr(nn, "BROADCAST_BYTES", -1 if name == "references" else 1 << 18)
    written, checkpoint = [], nn._checkpoint

    def sized(df):
        out = checkpoint(df)
        written.extend(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles())
        return out

    for m in (nn, metric_index):
        monkeypatch.setattr(m, "_checkpoint", sized)
    found = nn._compared(queries, frame, 5, True, None)
    assert found.count() <= 5 * n * (1 if name == "references" else 3)
    got = sorted((r.q, r["rank"], r.id) for r in nn.nearest(queries, frame, 5, leave_self=True).collect())
    want = [(q, rank + 1, j) for q in range(n) for rank, j in enumerate([j for j in np.argsort(np.sqrt(((x - x[q]) ** 2).sum(axis=1)), kind="stable") if j != q][:5])]
    assert got == want
    print(f"{sum(written)} bytes written by two searches over {x.nbytes}")
    assert sum(written) < 2.5 * x.nbytes


def test_mining_asks_again_only_where_a_negative_is_nearer(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=3).tolist(), "positive" if k % 3 == 0 else "negative") for k in range(90)]
    asked = []
    nearest = nn.nearest

    def watched(queries, *rest, **more):
        asked.append(queries.count())
        return nearest(queries, *rest, **more)

    monkeypatch.setattr(nn, "nearest", watched)
    got = {r.a: (r.p, r.n) for r in training.mine(spark.createDataFrame(rows, "id long, v array<double>, label string").repartition(2)).collect()}
    v = {k: np.array(x) for k, x, _ in rows}
    far = lambda a, b: float(np.linalg.norm(v[a] - v[b]))
    nearer = 0
    for a in range(0, 90, 3):
        ap, p = min((far(a, b), b) for b in range(0, 90, 3) if b != a)
        negatives = sorted((far(a, b), b) for b in range(90) if b % 3)
        semi = [b for d, b in negatives if ap < d < ap + 0.2]
        assert got[a] == (p, (semi or [negatives[0][1]])[0])
        nearer += negatives[0][0] <= ap
    assert asked == [30, 30, nearer] and 0 < nearer < 30


def test_leaving_out_compares_each_pair_once(spark, monkeypatch):
    """every seed searched both thirds that it keeps."""
    rng = np.random.default_rng(9)
    v = {k: rng.integers(0, 4, 3).astype(float) for k in range(-6, 60)}  # ties, and ids below zero
    rows = [(k, x.tolist(), f"l{k % 2}", k % 3 if k >= 0 else -(-k % 3)) for k, x in v.items()]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label string, third int").repartition(2)
    pairs, compared = [], nn._compared

    def watched(q, r, *rest):
        pairs.append(q.count() * r.count())
        return compared(q, r, *rest)

    monkeypatch.setattr(nn, "_compared", watched)
    got = nn.nearest_leaving_out(frame.where("id < 20").select("id", "v"), frame, "third", [0, 1, 2], 4).collect()
    assert sum(pairs) == 26 * 66
    third = {r[0]: r[3] for r in rows}
    want = set()
    for left in range(3):
        for q in range(-6, 20):
            near = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), k) for k, x in v.items() if third[k] != left)
            want |= {(left, q, k, d, n + 1, f"l{k % 2}") for n, (d, k) in enumerate(near[:4])}
    assert {(r.left_out, r.q, r.id, r.d, r["rank"], r.label) for r in got} == want and len(got) == len(want)
    assert nn.nearest_leaving_out(frame.select("id", "v"), frame.where("id > 99"), "third", [0], 4).count() == 0


def test_per_seed_searches_each_third_once(spark, sf_dir, monkeypatch):
    from latticework.queries import tables

    pairs, compared = [], nn._compared

    def watched(q, r, *rest):
        pairs.append(q.count() * r.count())
        return compared(q, r, *rest)

    monkeypatch.setattr(nn, "_compared", watched)
    tables.tr13(spark, sf_dir).collect()
    v = tables.vectors(spark, sf_dir)
    assert sum(pairs) == len(tables.CONFIGURATIONS) * v.where("part = 'query'").count() * v.where("part = 'train'").count()
