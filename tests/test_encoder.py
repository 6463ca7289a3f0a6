"""The graph encoder against a loop over nodes and edges in numpy."""

import numpy as np

from latticework.operators import encoder, spatial
from latticework.queries.spatial import residue_graphs


def brute(nodes, edges, w):
    """nodes: {(sid, res): features}; edges: [(sid, src, dst, distance, flag)]."""
    one = lambda x, l: l[0] @ x + l[1]  # noqa: E731,E741
    h = {k: one(np.array(x), w["input"][0]) for k, x in nodes.items()}
    for k in range(sum(n.startswith("layer") for n in w)):
        a, b, c = w[f"layer{k}"]
        new = {}
        for (sid, i), x in h.items():
            got = [one(encoder.silu(one(np.concatenate([x, h[sid, s], [d, f]]), a)), b) for e, s, t, d, f in edges if (e, t) == (sid, i)]
            y = encoder.silu(one(np.concatenate([x, np.mean(got, axis=0) if got else np.zeros(len(x))]), c)) + x
            new[sid, i] = (y - y.mean()) / np.sqrt(y.var() + 1e-5)
        h = new
    out = {}
    for sid in {s for s, _ in h}:
        p = np.mean([x for (s, _), x in h.items() if s == sid], axis=0)
        e = one(encoder.silu(one(p, w["readout"][0])), w["readout"][1])
        out[sid] = e / np.linalg.norm(e)
    return out


def test_encoder(spark):
    rng = np.random.default_rng(7)
    at = {(s, r): rng.normal(size=3) * 4 for s in range(4) for r in range(6)} | {(9, 0): np.zeros(3)}  # 9: a lone node
    nodes = {k: rng.normal(size=5).tolist() for k in at}
    res = spark.createDataFrame([(s, r, *map(float, p)) for (s, r), p in at.items()], "sid long, res_id int, x double, y double, z double")
    edges = spatial.radius_graph(res, 6.0)
    listed = [(e.sid, e.src, e.dst, e.distance, float(e.is_adjacent)) for e in edges.collect()]
    w = encoder.weights(5, hidden=8, embed=3, layers=2, seed=1)
    frame = spark.createDataFrame([(s, r, x) for (s, r), x in nodes.items()], "sid long, res_id int, features array<double>").repartition(3)
    got = {r.sid: r.embedding for r in encoder.encode(frame, edges, w).collect()}
    want = brute(nodes, listed, w)
    assert set(got) == set(want) and len(listed) > 40
    for sid, e in want.items():
        np.testing.assert_allclose(got[sid], e, atol=1e-9)
        np.testing.assert_allclose(np.linalg.norm(got[sid]), 1)


def test_weights_repeat():
    a, b = encoder.weights(5, seed=3), encoder.weights(5, seed=3)
    assert all((x == y).all() for n in a for u, v in zip(a[n], b[n], strict=True) for x, y in zip(u, v, strict=True))
    assert not (encoder.weights(5, seed=4)["input"][0][0] == a["input"][0][0]).any()


def test_query_on_given_structures(spark, sf_dir):
    nodes, edges = residue_graphs(spark, sf_dir)
    some = [0, 1, 7, 35]
    nodes, edges = nodes.where(nodes.sid.isin(some)), edges.where(edges.sid.isin(some))
    w = encoder.weights(104)
    want = brute({(r.sid, r.res_id): r.features for r in nodes.collect()}, [(e.sid, e.src, e.dst, e.distance, float(e.is_adjacent)) for e in edges.collect()], w)
    for r in encoder.encode(nodes, edges, w).collect():
        np.testing.assert_allclose(r.embedding, want[r.sid], atol=1e-7)
