"""Running sums, medians, digests and nearest neighbours against plain Python, on every path."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from latticework.operators import metric_index, neighbours, ordered


def test_before_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLE", 100)
    rng = random.Random(1)
    rows = [(rng.randrange(50), k, rng.randrange(9)) for k in range(700)]
    got = {r.b: r.s for r in ordered.before(spark.createDataFrame(rows, "a long, b long, n long"), ["a", "b"], "s", "n").collect()}
    want, total = {}, 0
    for _, b, n in sorted(rows):
        want[b] = total
        total += n
    assert got == want


def test_upper_median(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLE", 50)
    rng = random.Random(2)
    rows = [(k, rng.randrange(20)) for k in "abc" for _ in range(101)] + [("d", 4), ("d", 9), ("e", 1), ("e", None), (None, 3), (None, 3)]
    groups = defaultdict(list)
    for k, x in rows:
        if x is not None:
            groups[k].append(x)
    got = {r.k: r.upper_median for r in ordered.upper_median(spark.createDataFrame(rows, "k string, x long"), "k", "x").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}
    assert ordered.upper_median(spark.createDataFrame([], "k string, x long"), "k", "x").count() == 0


def test_sorted_digest(spark):
    rows = [(k % 3 if k % 7 else None, k, f"line {k}" if k % 5 else None) for k in range(60)]
    got = {r.g: r.digest for r in ordered.sorted_digest(spark.createDataFrame(rows, "g long, k long, t string").repartition(5), "g", ["k"], "t", "|").collect()}
    assert got == {g: hashlib.sha256("|".join(t or "" for h, _, t in rows if h == g).encode()).hexdigest() for g in (None, 0, 1, 2)}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_nearest(spark, monkeypatch, limit):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)  # the metric index where nothing may be broadcast
    monkeypatch.setattr(metric_index, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "BATCH_ROWS", 7)
    rng = random.Random(3)
    rows = [(k, [float(rng.randrange(3)) for _ in range(4)] if k % 11 else None, f"l{k % 2}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    known = {k: v for k, v, _ in rows if v}
    want = {}
    for q, qv in known.items():
        far = sorted((math.dist(qv, v), k) for k, v in known.items() if k != q and math.dist(qv, v) > 1.0)
        want[q] = [(k, round(d, 9), f"l{k % 2}") for d, k in far[:4]]
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df.selectExpr("id", "v", "1.0D as floor"), df, 4, leave_self=True, above="floor").collect(), key=lambda r: (r.q, r["rank"])):
        got[r.q].append((r.id, round(r.d, 9), r.label))
    assert got == {q: w for q, w in want.items() if w}
