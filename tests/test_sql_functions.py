"""The functions of a session, called from SQL."""

import math

import numpy as np
import pytest

from latticework.functions import sql


@pytest.fixture
def session(spark):
    sql.register(spark)
    return spark


def test_distance(session):
    assert session.sql("SELECT point_distance(array(0D, 3D), array(4D, 0D)), point_distance(NULL, array(1D)), point_distance(array(), array())").first()[:] == (5.0, None, 0.0)


def test_vote_is_the_query(session, sf_dir):
    from latticework.queries.neighbours import kn1

    session.read.parquet(f"{sf_dir}/embeddings.parquet").createOrReplaceTempView("e")
    got = session.sql("""
        WITH v AS (SELECT vec_id AS id, transform(embedding, x -> CAST(x AS DOUBLE)) AS v, IF(label % 3 = 0, 'positive', 'negative') AS label FROM e),
        p AS (SELECT q.id AS q, named_struct('d', point_distance(q.v, t.v), 'id', t.id, 'label', t.label) AS s FROM v q JOIN v t ON q.id % 5 = 0 AND t.id % 5 <> 0)
        SELECT q AS id, knn_vote(collect_list(s), 5) AS pred FROM p GROUP BY q""")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kn1(session, sf_dir).collect()))


def test_vote_ties_and_edges(session):
    rows = "array(named_struct('d', 2D, 'id', 5L, 'label', 'b'), named_struct('d', 1D, 'id', 9L, 'label', 'a'), named_struct('d', 2D, 'id', 4L, 'label', 'c'), named_struct('d', 3D, 'id', 1L, 'label', 'b'))"
    assert session.sql(f"SELECT knn_vote({rows}, 1), knn_vote({rows}, 3), knn_vote({rows}, 4), knn_vote({rows}, 50), knn_vote(NULL, 3)").first()[:] == ("a", "a", "b", "b", None)


def test_superposition_error(session):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(6, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    rows = [(1, p.tolist(), (p @ turn.T + 4).tolist()), (2, p.tolist(), (-p).tolist()), (3, None, p.tolist()), (4, p.tolist(), p[:3].tolist()), (5, [], [])]
    session.createDataFrame(rows, "id int, p array<array<double>>, q array<array<double>>").createOrReplaceTempView("points")
    got = {r.id: r.e for r in session.sql("SELECT id, superposition_error(p, q) AS e FROM points").collect()}
    assert got[1] < 1e-9 < got[2] and got[3] is got[4] is got[5] is None
    best = min(math.sqrt((((p - p.mean(0)) @ np.linalg.qr(m)[0] * 1.0 + (p - p.mean(0))) ** 2).sum() / 6) for m in rng.normal(size=(200, 3, 3)) if np.linalg.det(np.linalg.qr(m)[0]) > 0)
    assert got[2] <= best + 1e-9
