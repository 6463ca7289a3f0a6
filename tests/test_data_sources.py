"""The paged store and the PDB source: restarts without loss or repeats, pushed filters, cut columns."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from latticework.sources import paged, pdb_source, sinks
from latticework.sources import text as s

PDB = """HEADER    x
MODEL        1
ATOM      1  N   HIS A   1      11.104   6.134  -6.504  1.00 20.50           N
ATOM      2  CA AHIS A   1      11.639   6.071  -5.147       21.00
ATOM      3  CA BHIS A   1      11.600   6.000  -5.100  0.50 21.00           C
HETATM    4 ZN    ZN B   2       1.000   2.000   3.000  0.90 30.00          ZN
ATOM      5  O   ASP B   3A      1.500   2.500   3.500  1.00 31.00           O
ENDMDL
MODEL        2
ATOM      6  N   HIS A   1      99.104   6.134  -6.504  1.00 20.50           N
ENDMDL
"""


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        (tmp_path / f"x{k}.y_{k}.pdb").write_text(PDB.replace("11.104", f"1{k}.104"))
    (tmp_path / "empty.pdb").write_text("")
    (tmp_path / "cr.pdb").write_text(PDB.replace("\n", "\r\n").replace("MODEL        1\r\n", "").replace("ENDMDL", "REMARK"))
    return str(tmp_path)


def test_source_gives_the_rows_of_the_line_parser(spark, folder):
    pdb_source.register(spark)
    got = spark.read.format("latticework_pdb").load(folder)
    want = s.parse_pdb(s.read_lines(spark, folder)).withColumn("id", s.stem(F.col("path")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).withColumn("line", F.col("line").cast("int")).collect()))
    assert got.count() == 6 * 4


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_filters_are_pushed_and_columns_cut(spark, folder, monkeypatch):
    pdb_source.register(spark)
    whole = spark.read.format("latticework_pdb").load(folder)
    few = spark.read.format("latticework_pdb").schema("id string, chain_id string, x double").load(folder)
    got = few.where((F.col("chain_id") == "B") & (F.col("x") > 1.2))
    assert sorted((r.id, r.x) for r in got.collect()) == sorted((r.id, r.x) for r in whole.collect() if r.chain_id == "B" and r.x > 1.2)
    physical = plan(got).split("== Physical Plan ==")[1]
    assert re.search(r"x#\d+ > 1.2", physical) and not re.search(r"chain_id#\d+ = B", physical)  # the reader has it, Spark does not test it again
    assert re.search(r"BatchScan latticework_pdb\[id#\d+, chain_id#\d+, x#\d+\]", physical)
    reader = pdb_source.PdbReader(folder, ["id", "chain_id", "x"])
    left = list(reader.pushFilters([pdb_source.EqualTo(("chain_id",), "B"), pdb_source.In(("chain_id",), ("A", "B")), pdb_source.In(("element",), ("O",)), pdb_source.EqualTo(("x",), 1.0)]))
    assert [f.attribute for f in left] == [("x",)] and reader.wanted == {"chain_id": {"B"}, "element": {"O"}}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6


def test_partitions_follow_the_bytes(folder, monkeypatch):
    monkeypatch.setattr(pdb_source, "PARTITION_BYTES", 1000)
    parts = pdb_source.PdbReader(folder, ["id"]).partitions()
    assert len(parts) > 2 and sum(len(p.paths) for p in parts) == 7


def entries(spark, lo, hi):
    return spark.createDataFrame([(f"P{k:05d}", "HHHDC" * (k % 3), f"o{k % 4}") for k in range(lo, hi)], "accession string, sequence string, organism string").repartition(3)


def test_pages(spark, tmp_path):
    paged.register(spark)
    store = str(tmp_path / "store")
    paged.write_pages(entries(spark, 0, 95), store, 10)
    df = spark.read.format("latticework_paged").load(store)
    assert df.rdd.getNumPartitions() == 10
    assert sorted(r.accession for r in df.collect()) == [f"P{k:05d}" for k in range(95)]
    assert spark.read.format("latticework_paged").schema("organism string").load(store).distinct().count() == 4
    reader = paged.PagedReader({"path": store, "first": "00000007"}, ["accession"])
    assert [p.cursor for p in reader.partitions()] == ["00000007", "00000008", "00000009"]


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    store, out, state = (str(tmp_path / n) for n in ("store", "out", "state"))
    accept = [F.length("sequence") > 0]
    excluded = spark.createDataFrame([("P00001",), ("P00077",)], "accession string")
    want = lambda n: [f"P{k:05d}" for k in range(n) if k % 3 and k not in (1, 77)]
    found = lambda: sorted(r.accession for r in spark.read.parquet(out).collect())
    paged.write_pages(entries(spark, 0, 70), store, 10)
    for n in (70, 70):  # the second start finds nothing new
        paged.scan_into(spark, store, out, state, accept, excluded, pages=2)
        assert found() == want(n)
    paged.write_pages(entries(spark, 70, 131), store, 10, first=7)
    paged.scan_into(spark, store, out, state, accept, excluded, pages=2)
    assert found() == want(131)


def test_a_batch_that_failed_is_planned_again(spark, tmp_path):
    """The query dies in its third batch; started again it goes on with exactly that batch."""
    paged.register(spark)
    store, out, state = (str(tmp_path / n) for n in ("store", "out", "state"))
    paged.write_pages(entries(spark, 0, 80), store, 10)
    source = spark.readStream.format("latticework_paged").option("path", store).option("progress", f"{state}/progress").option("pagesPerBatch", 2).load()

    def batch(fail):
        def write(df, k):
            if fail and k == 2:
                raise RuntimeError("lost")
            df.write.mode("overwrite").parquet(f"{out}/batch={k}")

        return write

    with pytest.raises(Exception, match="lost"):
        query = source.writeStream.foreachBatch(batch(True)).option("checkpointLocation", f"{state}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    query = source.writeStream.foreachBatch(batch(False)).option("checkpointLocation", f"{state}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(out)
    assert sorted(r.accession for r in rows.collect()) == [f"P{k:05d}" for k in range(80)]
    assert {r.batch: r.n for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {k: 20 for k in range(4)}


def test_batches_of_a_backlog_grow(spark, tmp_path):
    """41 pages in 5 batches of 2, 4, 8, 16 and 11 pages, each row once."""
    store, out, state = (f"{tmp_path}/{n}" for n in ("store", "out", "state"))
    rows = spark.range(41).selectExpr("format_string('P%04d', id) accession", "'HDC' sequence", "'x' organism")
    paged.write_pages(rows, store, 1)
    paged.scan_into(spark, store, out, state, [], pages=2)
    assert sorted(r.accession for r in spark.read.parquet(out).collect()) == [f"P{i:04d}" for i in range(41)]
    assert len([n for n in os.listdir(f"{state}/checkpoint/commits") if n.isdigit()]) == 5


def test_pocket_files_are_written_by_tasks_and_read_in_batches(spark, tmp_path, monkeypatch):
    """a folder, a checksum and a move on the driver for every file; one batch and up to 32 MB of files a task."""
    rows = [(f"s{k}", n, f"ATOM  {n + 1:5d}  N   HIS A{k % 999:4d}    {k:8.3f}{n:8.3f}   0.000  1.00  0.00           N") for k in range(60) for n in range(3)]
    lines = spark.createDataFrame(rows + [("a/b", 0, rows[0][2])], "id string, line int, value string").repartition(5)
    path = tmp_path / "pockets"
    sinks.write_pocket_files(lines, f"file://{path}")
    files = sorted(p.name for p in path.rglob("*") if p.is_file())
    assert files == sorted([f"id=s{k}.pdb" for k in range(60)] + ["id=a%2Fb.pdb"]) and os.listdir(tmp_path) == ["pockets"]
    monkeypatch.setattr(pdb_source, "FILES", 25)
    reader = pdb_source.PdbReader(str(path), ["id", "line", "x", "y"])
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) == len(batches) == 3
    got = sorted((r["id"], r["line"] - 1, r["x"], r["y"]) for b in batches for r in b.to_pylist() if r["id"] != "a%2Fb")
    assert got == sorted((f"s{k}", n, float(k), float(n)) for k in range(60) for n in range(3))
    with pytest.raises(FileExistsError):
        sinks.write_pocket_files(lines, f"file://{path}")
    failed = lines.withColumn("value", F.when(F.col("id") == "s7", F.raise_error(F.lit("no line"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no line"):
        sinks.write_pocket_files(failed, f"file://{tmp_path / 'more'}")
    assert not (tmp_path / "more").exists()
