"""A task of references gives k rows a query, however many blocks it reads."""

import numpy as np

from latticework.operators import neighbours as nn


def test_a_task_keeps_the_k_best(spark, monkeypatch):
    monkeypatch.setattr(nn, "BATCH_ROWS", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (60, 3)).astype(float)  # many ties
    q = spark.createDataFrame([(i, x[i].tolist(), float(i % 3)) for i in range(20)], "id long, v array<double>, low double").repartition(2)
    r = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, v array<double>").repartition(2)
    for above in (None, "low"):
        rows = nn._compared(q, r, 4, True, above)
        assert rows.count() <= 2 * 4 * 20
        got = {}
        for row in nn.nearest(q, r, 4, leave_self=True, above=above).collect():
            got.setdefault(row.q, {})[row["rank"]] = row.id
        for i in range(20):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            want = [j for j in sorted(range(60), key=lambda j: (d[j], j)) if j != i and (above is None or d[j] > i % 3)][:4]
            assert [got[i][k] for k in sorted(got.get(i, {}))] == want if want else i not in got
