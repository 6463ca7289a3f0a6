"""The motif search on exact fixtures: what must be found, what must not."""

import math
import random

import numpy as np

from latticework.functions.geometry import covariance, point, with_rmsd
from latticework.operators import motif

T = motif.EXAMPLE
ROLES = ["ASP_O", "CYS_S", "HIS_N", "HIS_N", "HIS_N", "HIS_N"]
SCHEMA = "sid long, idx int, res int, role string, x double, y double, z double, modified boolean"


def atoms(spark, points, roles=ROLES, modified=False):
    return spark.createDataFrame([(1, k, k, r, *map(float, p), modified and r == "CYS_S") for k, (p, r) in enumerate(zip(points, roles, strict=True))], SCHEMA)


def test_exact_template_is_supported(spark):
    row = motif.search(atoms(spark, [*T.first, *T.second])).first()
    assert row.architecture_call and row.status == "supported" and row.rmsd < 1e-4
    assert row.n_mixed >= 1 and row.n_his >= 1


def test_without_sulfur_nothing_is_called(spark):
    row = motif.search(atoms(spark, [*T.first, *T.second], ["ASP_O", "HIS_N", "HIS_N", "HIS_N", "HIS_N", "HIS_N"])).first()
    assert not row.architecture_call and row.n_mixed == 0


def test_modified_cysteine_is_kept_apart(spark):
    a = atoms(spark, [*T.first, *T.second], modified=True)
    pairs = motif.triad_pairs(motif.mixed_triads(a, T), motif.histidine_triads(a, T), T)
    assert all(r.smod for r in motif.alignments(pairs, T).collect())


def test_cap_makes_a_structure_unavailable(spark):
    row = motif.search(atoms(spark, [*T.first, *T.second]), cap=1).first()
    assert row.status == "unavailable" and not row.architecture_call


def test_error_is_the_least_over_proper_rotations(spark):
    rng = random.Random(5)
    ys = [*T.first, *T.second]
    sets = [[[rng.gauss(0, 4) for _ in range(3)] for _ in range(6)] for _ in range(40)]
    sets.append([[-p[0], p[1], p[2]] for p in ys])  # a reflection
    df = spark.createDataFrame([(k, *[c for p in s for c in p]) for k, s in enumerate(sets)], "k int, " + ", ".join(f"{c}{j} double" for j in range(6) for c in "xyz"))
    h = covariance([point(names=(f"x{j}", f"y{j}", f"z{j}")) for j in range(6)], ys)
    got = {r.k: r.rmsd for r in with_rmsd(df.select("k", *(v.alias(n) for n, v in h.items())), 6).collect()}
    for k, s in enumerate(sets):
        x, y = np.array(s) - np.mean(s, axis=0), np.array(ys) - np.mean(ys, axis=0)
        u, w, vt = np.linalg.svd(x.T @ y)
        w[2] *= np.sign(np.linalg.det(u @ vt))
        want = math.sqrt(max(0.0, ((x**2).sum() + (y**2).sum() - 2 * w.sum()) / 6))
        assert abs(got[k] - want) < 1e-5


def test_pose_gates_rank_before_the_error(spark):
    """The exact site is blocked by an atom in the ligand's place: the call of the architecture stays, that of the pose goes."""
    a = atoms(spark, [*T.first, *T.second])
    free = motif.search(a).first()
    assert free.full_pose_call and np.allclose(free.metals, T.metals, atol=1e-3)
    wall = a.select("sid", "x", "y", "z").union(spark.createDataFrame([(1, *p) for p in T.ligand], "sid long, x double, y double, z double"))
    row = motif.search(a, protein=wall).first()
    assert row.architecture_call and not row.full_pose_call and row.status == "not_supported" and row.clash_share == 1.0
    assert motif.search(atoms(spark, [*T.first, *T.second], modified=True)).first().native_full_pose_call is False


def test_motion_is_the_one_that_was_made(spark):
    from latticework.functions.geometry import moved, with_superposition
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    fixed, sets = [*T.first, *T.second], []
    for _ in range(20):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q[:, 2] *= np.linalg.det(q)
        sets.append((q, rng.normal(size=3)))
    df = spark.createDataFrame([(k, [float(v) for v in (np.array(fixed) @ q + t).reshape(-1)]) for k, (q, t) in enumerate(sets)], "k int, target array<double>")
    probe = (1.0, -2.0, 3.0)
    at = moved(tuple(F.lit(v) for v in probe), F.col("rotation"), F.col("translation"))
    for r in with_superposition(df, fixed).select("k", *(v.alias(c) for c, v in zip("xyz", at, strict=True))).collect():
        q, t = sets[r.k]
        assert np.allclose([r.x, r.y, r.z], np.array(probe) @ q + t, atol=1e-9)
    assert with_superposition(df.where("k < 0"), fixed).count() == 0
