"""Helpers shared by the training-data operators: shared folders, Arrow slicing and hashing.

Everything here runs either on the driver for a moment (folders, settings) or inside a task on one
bounded slice of an Arrow batch.  Hashes are plain 64-bit numbers, equal in every worker.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass takes; a longer single text is one pass of its own.
SLICE_BYTES = 1 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor can reach, below ``spark.checkpoint.dir``.

    Only where that setting is missing (tests, one machine) a temporary folder is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, and lost
    executors cost no recomputation of what came before.  ``arrow_rows``: rows of an Arrow batch in this
    write, where whole texts go to Python and the default of 10,000 of them would take too much memory."""
    spark = df.sparkSession
    path, setting = shared_dir(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(arrow_rows or before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``cut`` tables that nothing reads any more.  A folder that cannot be deleted stays."""
    for folder in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        try:
            fs, path = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))
            fs.delete_dir(path)
        except (OSError, pa.ArrowInvalid):
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of ``text`` each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), offs - (offs[0] if len(offs) else 0)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64's) over an array of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE, _BYTES = np.uint64(0xD6E8FEB86659FD93), mix(np.arange(256, dtype=np.uint64) * np.uint64(0x1000003) + np.uint64(77))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts, A-Z lower-cased, and each text's first word (with an end).

    ``inside``: for each byte value, whether it belongs to a word; by default all but ASCII spaces.
    """
    n, texts = len(buf), len(offs) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    low = _LOWER[buf]
    word = ~_SPACE[low] if inside is None else inside[low]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~word[:-1]
    at = offs[:-1]
    first[at[at < n]] = True
    first &= word
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    power, inverse = powers(n)
    value = _BYTES[low]
    value *= power
    value[~word] = 0
    sums = np.add.reduceat(value, starts) * inverse[starts]
    return mix(sums), np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each run of ``size`` words; of the whole sequence where it is shorter."""
    if len(words) == 0:
        return words
    if len(words) < size:
        return mix(_chain(words[:, None]) + np.uint64(len(words)))
    return mix(_chain(np.stack([words[k : len(words) - size + 1 + k] for k in range(size)])) + np.uint64(size))


def _chain(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(rows.shape[1], np.uint64)
    for r in rows:
        out *= _M2
        out ^= out >> np.uint64(29)
        out += r
    return out


def tmp_path(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else os.path.normpath(uri)
