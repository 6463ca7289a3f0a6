"""Parsers and filters on the awkward cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import graph, metric_index, neighbours, triage
from latticework.sources import npz, sinks
from latticework.sources import text as s

PDB = """HEADER    TEST
MODEL        1
ATOM      1  CA AASP A  10       1.000   2.000   3.000  1.00 50.00           C
ATOM      2  CA BASP A  10       9.000   9.000   9.000  1.00 50.00           C
ATOM      3  OD1 ASP A  10A      4.000   5.000   6.000
HETATM    4 ZN    ZN A 201       7.000   8.000   9.000  0.80 20.00          ZN
ENDMDL
MODEL        2
ATOM      5  CA  ASP A  10       0.000   0.000   0.000  1.00 50.00           C
ENDMDL
"""


def lines(spark, text, path="WP_1.1.pdb"):
    return spark.createDataFrame([(path, k + 1, v) for k, v in enumerate(text.split("\n"))], "path string, line int, value string")


def test_pdb(spark):
    got = s.parse_pdb(lines(spark, PDB)).orderBy("line").collect()
    assert [(r.atom_name, r.element, r.ins_code, r.occupancy, r.hetero) for r in got] == [("CA", "C", "", 1.0, False), ("OD1", "O", "A", 1.0, False), ("ZN", "ZN", "", 0.8, True)]


def test_stem(spark):
    df = spark.createDataFrame([("/a/WP_1.1.pdb",), ("x.y",)], "p string").select(s.stem(F.col("p")).alias("s"))
    assert [r.s for r in df.collect()] == ["WP_1.1", "x.y"]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    (tmp_path / "b.pdb").write_text(PDB)
    assert s.parse_pdb(s.read_lines(spark, str(tmp_path))).count() == 6
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.fa").write_text(">a one\nAC\nDE\n>b\nGG\n")
    assert {(r.id, r.sequence) for r in s.read_fasta(spark, str(tmp_path / "f")).collect()} == {("a", "ACDE"), ("b", "GG")}


def test_duplicate_fasta_ids_raise(spark):
    with pytest.raises(Exception, match="duplicate id"):
        s.unique_ids(spark.createDataFrame([("a",), ("a",)], "id string")).collect()


def test_later_pair_line_holds_for_both_directions(spark):
    rows = s.parse_pairs(lines(spark, "a.pdb\tb\t40\t9\t.9\t.8\t0\nb\ta\t60\t9\t.7\t.9\t0\na\ta\t99\t9\t1\t1\t0"))
    (r,) = s.last_of_pair(rows, "identity", "coverage").collect()
    assert (r.a, r.b, r.identity, r.coverage) == ("a", "b", 0.6, 0.7)


def test_short_domain_line_raises(spark):
    with pytest.raises(Exception, match="short domain line"):
        s.parse_domains(lines(spark, "# c\na b c")).collect()


def test_npz_upgrades_a_single_metal(spark, tmp_path):
    np.savez(tmp_path / "p.npz", metadata=json.dumps({"metal_confidence": None}), metal_coord=np.ones(3), coords=np.zeros((2, 3)), res_ids=np.array([1, 2]), atom_names=np.array(["CA", "N"]))
    (r,) = npz.read_npz(spark, str(tmp_path)).collect()
    assert r.metal_coords == [[1.0, 1.0, 1.0]] and r.metal_probabilities == [0.7] and r.n_atoms == 2


def test_export_is_whole_or_not_made(spark, tmp_path):
    df = spark.createDataFrame([(1, False), (2, True)], "id int, failed boolean")
    with pytest.raises(ValueError):
        sinks.export_all_or_none(df, "failed", str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    sinks.export_all_or_none(df.where("not failed"), "failed", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_unknown_label_raises(spark):
    with pytest.raises(Exception, match="unknown tier"):
        spark.createDataFrame([("x",)], "v string").select(triage.map_or_fail(F.col("v"), {"a": 1}, "tier").alias("t")).collect()


def test_components_ignore_unknown_ends_and_keep_lone_ids(spark):
    ids = spark.createDataFrame([(k,) for k in range(1, 8)], "id long")
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 6), (7, 99), (4, 4)], "a long, b long")
    got = {r.id: r.component for r in graph.components(ids, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_greedy_balance_prefers_the_family_then_the_load(spark):
    blocks = spark.createDataFrame([(1, "f", 5), (2, "f", 4), (3, "f", 1), (4, "g", 2)], "component long, family string, size long")
    got = {r.component: r.panel for r in graph.greedy_balance(blocks, 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_vote_tie_goes_to_the_nearer(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "q long, label string, rank int")
    assert neighbours.majority(rows, "q").first().pred == "b"


@pytest.mark.parametrize("above", [None, "floor"])
def test_large_sides_meet_in_a_grid(spark, monkeypatch, above):
    at = [(k * 7) % 12 for k in range(12)]
    v = spark.createDataFrame([(k, [float(x), 0.0], 2.0) for k, x in enumerate(at)], "id long, v array<double>, floor double")
    want = []
    for q in range(12):
        far = sorted((abs(at[q] - at[r]), r) for r in range(12) if r != q and (above is None or abs(at[q] - at[r]) > 2))
        want += [(q, r, float(d), n + 1) for n, (d, r) in enumerate(far[:3])]
    want.sort()
    found = lambda: sorted(tuple(r) for r in neighbours.nearest(v, v, 3, leave_self=True, above=above).select("q", "id", "d", "rank").collect())
    assert found() == want
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(metric_index, "BLOCK", 5)
    assert found() == want


def test_a_domain_line_is_made_and_split_once(spark):
    """conditions on the id and on the line repeated what made them."""
    made = spark.range(2).select(F.concat_ws(" \t ", F.concat(F.lit("p"), "id"), *[F.col("id").cast("string")] * 11, *[F.lit("7")] * 11).alias("value"), F.col("id").alias("line"))
    found = s.best_domain(spark.range(3).select(F.concat(F.lit("p"), "id").alias("id")), s.parse_domains(made))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("concat_ws(") == 1
    assert {(r.id, r.best_score, r.n_domains) for r in found.collect()} == {("p0", 7.0, 1), ("p1", 7.0, 1), ("p2", None, 0)}
