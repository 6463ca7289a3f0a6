"""SC2 as a data source: ``spark.read.format("latticework_pdb").load(folder)``.

Files are grouped into partitions by their bytes and their number; a batch holds the atoms of many small files.  Comparisons of ``chain_id`` and ``element`` with ``=`` and ``IN`` are
pushed into the reader (``spark.sql.python.filterPushdown.enabled``); a schema with fewer columns cuts only those
columns from the lines.  A file's lines are columns of one Arrow array and are cut at fixed widths by Arrow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes of the files of one partition, as far as files are not larger themselves, and most files of it; rows of a batch.
PARTITION_BYTES, FILES, ROWS = 32 << 20, 1000, 10_000
SCHEMA = (
    "id string, line int, hetero boolean, atom_name string, res_name string, chain_id string, res_id int, ins_code string, "
    "x double, y double, z double, occupancy double, b_factor double, element string"
)
_PUSHED = ("chain_id", "element")


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def structure_id(path: str) -> str:
    """The file's name without ``.pdb``; of a partitioned folder ``id=name/part``, the name there."""
    parts = path.split("/")
    name = next((p[3:] for p in parts if p.startswith("id=")), parts[-1])
    return name.removesuffix(".pdb")


def parse(text: bytes, columns: list[str], wanted: dict[str, set[str]]) -> dict[str, pa.Array]:
    """Columns of the atoms of a file's first model with a blank or A alternate location; of ``wanted``, only atoms
    with one of these values."""
    lines = pa.array(text.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"), pa.string())
    cut = lambda rows, a, n: pc.utf8_slice_codeunits(rows, a - 1, a - 1 + n)
    field = lambda rows, a, n: pc.utf8_trim_whitespace(cut(rows, a, n))
    kind = field(lines, 1, 6)
    models = pc.fill_null(pc.cast(pc.if_else(pc.match_substring_regex(lines, r"^MODEL\s+\d+"), pc.replace_substring_regex(lines, r"^MODEL\s+(\d+).*$", r"\1"), None), pa.int64()), 0)
    stop = pc.or_(pc.equal(kind, "ENDMDL"), pc.greater(models, 1))
    last = pc.index(stop, True).as_py()
    keep = pc.and_(pc.is_in(kind, pa.array(["ATOM", "HETATM"])), pc.is_in(cut(lines, 17, 1), pa.array([" ", "A", ""])))
    numbers = pc.indices_nonzero(keep)
    if last >= 0:
        numbers = numbers.filter(pc.less(numbers, pa.scalar(last, pa.uint64())))
    rows, number = lines.take(numbers), numbers

    def element(r: pa.Array) -> pa.Array:
        own = pc.utf8_upper(field(r, 77, 2))
        first = pc.utf8_upper(pc.replace_substring_regex(field(r, 13, 4), r"^[^A-Za-z]*([A-Za-z]?).*$", r"\1"))
        return pc.if_else(pc.equal(own, ""), first, own)

    cuts = {"chain_id": lambda r: field(r, 22, 1), "element": element}
    for name, values in wanted.items():
        ok = pc.is_in(cuts[name](rows), pa.array(sorted(values), pa.string()))
        rows, number = rows.filter(ok), number.filter(ok)
    blank = lambda a: pc.if_else(pc.equal(a, ""), None, a)
    real = lambda a, n: pc.cast(blank(field(rows, a, n)), pa.float64())
    make = cuts | {
        "line": lambda r: pc.cast(pc.add(number, pa.scalar(1, pa.uint64())), pa.int32()), "hetero": lambda r: pc.equal(field(r, 1, 6), "HETATM"), "atom_name": lambda r: field(r, 13, 4), "res_name": lambda r: field(r, 18, 3),
        "res_id": lambda r: pc.cast(blank(field(r, 23, 4)), pa.int32()), "ins_code": lambda r: field(r, 27, 1), "x": lambda r: real(31, 8), "y": lambda r: real(39, 8), "z": lambda r: real(47, 8),
        "occupancy": lambda r: pc.fill_null(real(55, 6), 1.0), "b_factor": lambda r: real(61, 6),
    }
    return {"": rows} | {c: make[c](rows) for c in columns if c != "id"}


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


class PdbReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.wanted = path, columns, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, folder = _open(self.path)
        held: list[str] = []
        out, size = [], 0
        prefix = self.path[: len(self.path) - len(folder)] if "://" in self.path else ""
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if held and (size + f.size > PARTITION_BYTES or len(held) >= FILES):
                out.append(Files(held))
                held, size = [], 0
            held.append(prefix + f.path)
            size += f.size
        return out + ([Files(held)] if held else [])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for path in partition.paths:
            fs, name = _open(path)
            with fs.open_input_stream(name) as f:
                found = parse(f.read(), self.columns, self.wanted)
            n = len(found.pop(""))
            if n:
                found["id"] = pa.array([structure_id(path)] * n)
                held.append(pa.RecordBatch.from_arrays([found[c] for c in self.columns], self.columns))
                rows += n
            if rows >= ROWS:
                yield from _joined(held)
                held, rows = [], 0
        yield from _joined(held)


class PdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "latticework_pdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PdbReader(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdbSource)
