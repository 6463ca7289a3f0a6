"""Sides that explode are not sent to every task, however small their files are; tasks do not grow with the input."""

from latticework.operators import workers
from latticework.plans import views
from latticework.plans.views import atoms, pairs


def test_atoms_are_not_broadcast(spark, sf_dir):
    plan = workers.surface_area(atoms(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_are_dealt_by_the_number_of_lines(spark, sf_dir, monkeypatch):
    """a task made the pairs of as many lines as there are for a core."""
    few = pairs(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(views, "LINES", lines // 20)
    many = pairs(spark, sf_dir)
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
