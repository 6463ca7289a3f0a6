"""Sinks: Spark's own writers, and the rule that an export is whole or not made."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import pdb_line

#: Folders that the files of an export are dealt into, by the hash of their ids.
FOLDERS = 256


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset (one machine) a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="latticework-sink-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> None:
    """SK1: a record a line."""
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SK6: with a header; dynamic columns come from a pivot before."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """SK3 to SK5: lines made by the expressions of ``sources.text``; null lines are not written."""
    df.where(F.col(column).isNotNull()).select(column).write.mode("errorifexists").text(path, lineSep="\n")


def pocket_lines(pockets: DataFrame) -> DataFrame:
    """SK4: id, line, value: the atoms of each pocket (path, coords, res_ids, atom_names, res_names, elements) as PDB
    lines in chain A, whatever chains they came from."""
    rows = pockets.select("path", F.posexplode(F.arrays_zip("coords", "res_ids", "atom_names", "res_names", "elements")).alias("n", "a"))
    at = [F.col("a.coords")[k] for k in range(3)]
    value = pdb_line(F.col("n") + 1, F.col("a.atom_names"), F.col("a.res_names"), F.lit("A"), F.col("a.res_ids"), *at, F.lit(1.0), F.lit(0.0), F.col("a.elements"))
    return rows.select(F.col("path").alias("id"), (F.col("n") + 1).alias("line"), value.alias("value"))


def write_pocket_files(lines: DataFrame, path: str) -> None:
    """SK4: id, line, value: one file a pocket, ``id=....pdb`` in one of ``FOLDERS`` folders.

    Tasks write the files themselves, each under a hidden name that is changed when it is whole, into a folder that takes
    its name when all are there: Spark's writer makes a folder, a checksum and two moves a file, the last on the driver."""
    fs, folder = _file_system(path)
    if fs.get_file_info(folder).type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} exists")
    making = f"{folder.rstrip('/')}-making-{uuid.uuid4().hex}"
    hidden = path.rstrip("/") + making[len(folder.rstrip("/")) :]
    rows = lines.select(F.col("id").cast("string").alias("id"), "line", F.col("value").cast("string").alias("value"))
    made = rows.repartition("id").sortWithinPartitions("id", "line").select("id", "value").mapInArrow(lambda batches: _files(batches, hidden), "n long")
    fs.create_dir(making, recursive=True)
    made.agg(F.sum("n")).collect()
    fs.move(making, folder)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path)) if re.match(r"^\w+:/", path) else (pafs.LocalFileSystem(), path)


def _files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes each run of equal ids; a run may go on in the next batch."""
    fs, top = _file_system(path)
    made: set[str] = set()

    def put(name: str | None, rows: list[str]) -> None:
        name = quote("__HIVE_DEFAULT_PARTITION__" if name is None else name, safe=" +,;@!~()$&<>|`")
        folder = f"{top}/{zlib.crc32(name.encode()) % FOLDERS:02x}"
        if folder not in made:
            fs.create_dir(folder, recursive=True)
            made.add(folder)
        part = f"{folder}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as out:
            out.write("".join(f"{v}\n" for v in rows if v is not None).encode())
        fs.move(part, f"{folder}/id={name}.pdb")

    now, held, n = None, [], 0
    for batch in batches:
        for name, value in zip(*(batch.column(c).to_pylist() for c in ("id", "value")), strict=True):
            if held and name != now:
                put(now, held)
                held, n = [], n + 1
            now = name
            held.append(value)
    if held:
        put(now, held)
        n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def write_fasta(df: DataFrame, name: Column, sequence: Column, path: str) -> None:
    """SK5: a header and a sequence line a record; empty and null sequences are not written."""
    record = F.when(F.length(sequence) > 0, F.concat(F.lit(">"), name, F.lit("\n"), sequence))
    write_lines(df.select(record.alias("record")), "record", path)


def export_all_or_none(rows: DataFrame, failed: str, path: str) -> int:
    """SK7: count the failures first; any aborts, and Spark's commit shows a finished write only."""
    n = rows.where(F.col(failed)).count()
    if n:
        raise ValueError(f"{n} rows failed; nothing was written")
    rows.drop(failed).write.mode("errorifexists").parquet(path)
    return n
