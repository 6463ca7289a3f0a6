"""SC17, SC18: scans of a paged store, where each page names the cursor of the next one.

``spark.read.format("latticework_paged")`` follows the cursors and reads every page, one partition each.
``spark.readStream`` takes up to ``pagesPerBatch`` pages a batch; with ``mostPagesPerBatch`` a batch may hold twice as many
pages as the one before, up to that number, so a long backlog is not a batch for every few pages.  The offset is the cursor that comes next, so a query
that is started again with its checkpoint goes on where it stopped.  Which cursor has been planned is also kept in
``progress`` (a folder that the driver reaches), since Spark does not tell a restarted reader where it was; it is
written before a batch runs, so it is never behind Spark's own log, and a planned batch that did not end is planned
again from that log.

A store is a folder ``cursor=.../*.parquet`` whose rows carry ``next``, the cursor of the following page (null on the
last one).  ``write_pages`` makes one from a table.  Pages are read where Spark runs the partition; the driver reads one
value of each.  Exclusion, sampling and composition (FI5 to FI7) are ordinary filters on the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.ordered import before

#: Pages of a batch of ``scan_into`` at most.
MOST_PAGES = 256
SCHEMA = "accession string, sequence string, organism string"


def write_pages(rows: DataFrame, path: str, size: int, first: int = 0) -> None:
    """``rows`` (accession, sequence, organism) in the order of accessions as pages of ``size`` rows.  The pages count
    from ``first``; a store grows by pages that are written behind its last one."""
    placed = before(rows, ["accession"], "pos").withColumn("page", F.floor(F.col("pos") / size) + first)
    last = placed.agg(F.max("page")).first()[0]
    cursor = lambda c: F.format_string("%08d", c)
    pages = placed.select("accession", "sequence", "organism", cursor(F.col("page")).alias("cursor"), F.when(F.col("page") < last, cursor(F.col("page") + 1)).alias("next"))
    pages.repartition("cursor").sortWithinPartitions("cursor", "accession").write.mode("append").partitionBy("cursor").parquet(path)


class _Store:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.first = options["path"].rstrip("/"), options.get("first", "00000000")
        self.after: dict[str, str] = {}

    def files(self, cursor: str) -> tuple[pafs.FileSystem, list[str]]:
        fs, folder = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{folder}/cursor={cursor}", allow_not_found=True))
        return fs, sorted(f.path for f in found if f.path.endswith(".parquet"))

    def next(self, cursor: str) -> str | None:
        """The cursor after a page.  A last page is followed by the next number: a page may be written there later."""
        if cursor in self.after:
            return self.after[cursor]
        fs, files = self.files(cursor)
        named = pq.read_table(files[0], columns=["next"], filesystem=fs).column(0)[0].as_py()
        self.after[cursor] = named or f"{int(cursor) + 1:08d}"  # a page that ended the store is followed by this one, too
        return self.after[cursor]

    def walk(self, cursor: str, most: int | None = None, end: str | None = None) -> Iterator[str]:
        while cursor != end and (most is None or most > 0) and self.files(cursor)[1]:
            yield cursor
            cursor, most = self.next(cursor), None if most is None else most - 1


class Page(InputPartition):
    def __init__(self, cursor: str) -> None:
        self.cursor = cursor


class _Pages:
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.store, self.columns = _Store(options), columns

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        fs, files = self.store.files(partition.cursor)
        for f in files:
            yield from pq.read_table(f, columns=self.columns, filesystem=fs).to_batches()


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return [Page(c) for c in self.store.walk(self.store.first)]


class PagedStreamReader(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        super().__init__(options, columns)
        self.most = int(options.get("pagesPerBatch", "4"))
        self.limit = int(options.get("mostPagesPerBatch", self.most))
        self.fs, folder = pafs.FileSystem.from_uri(options["progress"]) if "://" in options["progress"] else (pafs.LocalFileSystem(), options["progress"])
        self.file = f"{folder.rstrip('/')}/cursor.json"
        self.at = self.store.first
        if self.fs.get_file_info(self.file).type == pafs.FileType.File:
            with self.fs.open_input_stream(self.file) as f:
                self.at = json.loads(f.read())["cursor"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.store.first}

    def latestOffset(self) -> dict:  # noqa: N802
        found = 0
        for page in self.store.walk(self.at, self.most):
            self.at, found = self.store.next(page), found + 1
        if found == self.most:
            self.most = max(self.most, min(2 * self.most, self.limit))
        return {"cursor": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["cursor"])
        self.fs.create_dir(self.file.rsplit("/", 1)[0])
        with self.fs.open_output_stream(self.file) as f:
            f.write(json.dumps({"cursor": self.at}).encode())
        return [Page(c) for c in self.store.walk(start["cursor"], end=end["cursor"])]


class PagedSource(DataSource):
    """Options: path; first; for streams also progress, pagesPerBatch and mostPagesPerBatch.  A schema may name fewer columns."""

    @classmethod
    def name(cls) -> str:
        return "latticework_paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagedReader(self.options, schema.names)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return PagedStreamReader(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def scan_into(spark: SparkSession, store: str, out: str, state: str, accept: list, excluded: DataFrame | None = None, pages: int = 4) -> None:
    """SC18: goes on with the scan of a store until no page is left.  Rows that pass every condition of ``accept`` and
    are not in ``excluded`` (accession) are appended to ``out``; ``state`` holds the checkpoint."""
    register(spark)
    found = spark.readStream.format("latticework_paged").option("path", store).option("progress", f"{state}/progress").option("pagesPerBatch", pages).option("mostPagesPerBatch", MOST_PAGES).load()
    for condition in accept:
        found = found.where(condition)
    if excluded is not None:
        found = found.join(excluded.select("accession"), "accession", "left_anti")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{state}/checkpoint").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
