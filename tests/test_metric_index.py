"""The metric index against brute force, and how many pairs of vectors it lets meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import metric_index, neighbours


def brute(q, r, k, leave_self, above):
    out = {}
    for i, v in q.items():
        far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in r.items())
        far = [(j, d) for d, j in far if not (leave_self and i == j) and (above is None or d > above)]
        out[i] = [(j, round(d, 9)) for j, d in far[:k]]
    return {i: w for i, w in out.items() if w}


def run(spark, q, r, k, leave_self, above, seen=None):
    frame = lambda rows: spark.createDataFrame([(i, v, above) for i, v in rows.items()], "id long, v array<double>, above double").repartition(3)
    pairs = metric_index.search(frame(q), frame(r), k, leave_self, above is not None, len(r), seen)
    got = {}
    for row in sorted(neighbours.top_k(pairs, k).collect(), key=lambda x: (x.q, x["rank"])):
        got.setdefault(row.q, []).append((row.id, round(row.d, 9)))
    return got


def groups(rng, n, spread):
    centres = rng.normal(size=(25, 16)) * 5
    out = {k: (centres[k % 25] + spread * rng.normal(size=16)).tolist() for k in range(n)}
    for k in range(0, n // 3, 2):  # a third of all vectors is one vector or another like it
        out[k] = out[0]
    return out


@pytest.mark.parametrize("leave_self,above", [(True, None), (False, None), (True, 1.0), (True, 0.0)])
def test_same_rows_as_brute_force(spark, monkeypatch, leave_self, above):
    monkeypatch.setattr(metric_index, "BLOCK", 37)
    v = groups(np.random.default_rng(1), 300, 0.4)
    q = v if leave_self else {k + 1000: x for k, x in list(v.items())[::3]}
    assert run(spark, q, v, 6, leave_self, above) == brute(q, v, 6, leave_self, above)


def test_few_pairs_meet_where_vectors_fall_into_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16)) * 5
    v = {k: (centres[k % 25] + 0.4 * rng.normal(size=16)).tolist() for k in range(1500)}
    seen = spark.sparkContext.accumulator(0)
    assert run(spark, v, v, 5, True, None, seen) == brute(v, v, 5, True, None)
    print(f"{seen.value} of {len(v) ** 2} pairs met")
    assert seen.value < len(v) ** 2 / 5


def test_given_vectors(spark, sf_dir):
    """All directions are alike here: no bound excludes much, and the rows are right all the same."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double"))).collect()
    v = {r[0]: r[1] for r in rows}
    q = {k: x for k, x in v.items() if k % 5 == 0}
    seen = spark.sparkContext.accumulator(0)
    assert run(spark, q, v, 5, True, None, seen) == brute(q, v, 5, True, None)
    print(f"{seen.value} of {len(q) * len(v)} pairs met")


def test_edges(spark):
    assert run(spark, {1: [0.0]}, {}, 3, True, None) == {}
    assert run(spark, {}, {1: [0.0]}, 3, True, None) == {}
    assert run(spark, {1: [0.0], 2: [5.0]}, {1: [1.0], 2: [2.0]}, 3, True, None) == {1: [(2, 2.0)], 2: [(1, 4.0)]}
