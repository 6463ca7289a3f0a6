"""Arriving files are scored once each."""

from latticework.operators import motif
from latticework.streaming.incremental import ATOMS, score_arrivals
from tests.test_motif import ROLES


def test_each_file_once(spark, tmp_path):
    t, src = motif.EXAMPLE, str(tmp_path / "in")
    put = lambda sid: spark.createDataFrame([(sid, k, k, r, *map(float, p)) for k, (p, r) in enumerate(zip([*t.first, *t.second], ROLES, strict=True))], ATOMS).coalesce(1).write.mode("append").parquet(src)
    run = lambda: score_arrivals(spark, src, str(tmp_path / "out"), str(tmp_path / "check"), lambda df: motif.search(df).select("sid", "status")).awaitTermination()
    put(1)
    run()
    put(2)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.sid, r.status, r.batch) for r in got) == [(1, "supported", 0), (2, "supported", 1)]
