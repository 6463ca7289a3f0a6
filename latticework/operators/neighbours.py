"""Nearest-neighbour retrieval on embeddings: exact, in Arrow batches with numpy distances (``block_scan``).

Vectors: id, v (array<double>, all of one length; rows with a null vector are left out).  Ties go to the smaller
id.  A task holds some queries and the references pass it in blocks, so it gives k rows a query and nothing is copied
for each block of the other side: references whose bytes were counted and are few go to every task as one matrix, else
they are written once to the shared folder and every task reads them there.  Only where references are many and queries
few it is the other way round: each task holds all queries and its own references pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .block_scan import scan
from .graph import _checkpoint
from .ordered import before

#: Bytes of references that may be broadcast (of queries, an eighth; every executor keeps a copy on its disk), references
#: in a block, queries that a task holds at once, and the fewest for which it is worth another task.
BROADCAST_BYTES, BATCH_ROWS, HELD, LEAST = 8 << 20, 4096, 1 << 15, 512
_FOUND = "q long, id long, d double"


def _matrix(ids: pa.Array, v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 1)


def _size(df: DataFrame) -> tuple[int, int, bool]:
    """Rows and bytes of the vectors, and whether single precision holds all their numbers."""
    single = ~F.exists("v", lambda x: x.cast("float").cast("double") != x)
    n, b, every = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0)), F.min(F.coalesce(single, F.lit(True)))).first()
    return n, 8 * b, every


def _sent(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """ids, vectors and, where there is one, ``above``."""
    small = df.toArrow().combine_chunks()
    one = lambda c: small.column(c).combine_chunks() if small.num_rows else pa.array([], small.schema.field(c).type)
    return *_matrix(one("id"), one("v")), one("above").to_numpy(zero_copy_only=False) if "above" in small.column_names else None


def _read(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for f in files:
        fs, path = pafs.FileSystem.from_uri(f)
        with fs.open_input_file(path) as file:
            for b in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(BATCH_ROWS, columns=["id", "v"]):
                yield _matrix(b.column("id"), b.column("v"))


def _rows(ids: np.ndarray, got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(got[0]), 1 << 16):
        at, r, d = (x[lo : lo + (1 << 16)] for x in got)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(r, pa.int64()), pa.array(d, pa.float64())], ["q", "id", "d"])


def _compared(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool, above: str | None) -> DataFrame:
    q = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), "v", *([F.col(above).cast("double").alias("above")] if above else []))
    r = refs.where("v is not null").select(F.col("id").cast("long").alias("id"), "v")
    (nq, bq, q_single), (_, br, r_single) = _size(q), _size(r)
    half = lambda df, single: df.withColumn("v", F.col("v").cast("array<float>")) if single else df
    q, r = half(q, q_single), half(r, r_single)
    sc = queries.sparkSession.sparkContext
    if br > BROADCAST_BYTES and bq <= BROADCAST_BYTES >> 3:
        few = sc.broadcast(_sent(q))

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, v, top = few.value
            blocks = (_matrix((b := batch.slice(lo, BATCH_ROWS)).column("id"), b.column("v")) for batch in batches for lo in range(0, batch.num_rows, BATCH_ROWS))
            yield from _rows(ids, scan(ids, v, top, k, leave_self, blocks))

        return r.mapInArrow(passed, _FOUND)
    if br <= BROADCAST_BYTES:
        small = sc.broadcast(_sent(r))

        def blocks() -> Iterable[tuple[np.ndarray, np.ndarray]]:
            ids, v, _ = small.value
            return ((ids[lo : lo + BATCH_ROWS], v[lo : lo + BATCH_ROWS]) for lo in range(0, len(ids), BATCH_ROWS))
    else:
        files = [re.sub("^file:/(?!/)", "file:///", f) for f in _checkpoint(r).inputFiles()]

        def blocks() -> Iterable[tuple[np.ndarray, np.ndarray]]:
            return _read(files)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, v = _matrix(t.column("id").combine_chunks(), t.column("v").combine_chunks())
        yield from _rows(ids, scan(ids, v, t.column("above").to_numpy() if above else None, k, leave_self, blocks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD // 4):
                held.append(batch.slice(lo, HELD // 4))
                if sum(b.num_rows for b in held) >= HELD:
                    yield from searched(held)
                    held = []
        if held:
            yield from searched(held)

    tasks = max(1, -(-nq // HELD), min(3 * sc.defaultParallelism, nq // LEAST))
    return q.repartition(tasks, "id").mapInArrow(run, _FOUND)


def nearest(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool = False, above: str | None = None) -> DataFrame:
    """q, id, d, rank (1 to k, by distance and id) and the reference's other columns, for each query.

    ``leave_self`` leaves out references with the query's id; ``above`` names a column of the queries: only
    references farther than it count.
    """
    top = top_k(_compared(queries, refs, k, leave_self, above), k)
    keep = [c for c in refs.columns if c not in ("id", "v")]
    return top.join(refs.select("id", *keep), "id").select("q", "id", "d", "rank", *keep)


def nearest_leaving_out(queries: DataFrame, refs: DataFrame, part: str, values: list, k: int) -> DataFrame:
    """``nearest`` for each of ``values`` among the references whose ``part`` is another: left_out, q, id, d, rank and the
    reference's other columns.  Each of the parts, which are few, is searched once for all values that take it in."""
    parts = [r[0] for r in refs.select(part).distinct().collect()] or [None]
    found = None
    for p in parts:
        own = _compared(queries, refs.where(F.col(part) == F.lit(p)), k, False, None)
        found = own if found is None else found.union(own)
    # Dealt by query before each row is repeated for the values that take it in; what follows needs no shuffle of its own.
    dealt = found.join(refs.drop("v"), "id").repartition("q")
    rows = dealt.withColumn("left_out", F.explode(F.array(*map(F.lit, values)))).where(F.col(part) != F.col("left_out"))
    return top_k(rows, k, "left_out", "q").drop(part)


def top_k(pairs: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k nearest of each query (or of other ``keys``) with their rank (partial top-k before the shuffle)."""
    by = Window.partitionBy(*(keys or ["q"])).orderBy("d", "id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def majority(rows: DataFrame, key: str | list[str], label: str = "label", rank: str = "rank") -> DataFrame:
    """GB4: the most frequent label; of equals the one that comes first by ``rank``."""
    keys = [key] if isinstance(key, str) else key
    n = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("pred"))


def vote_fraction(neighbours: DataFrame, positive: Column) -> DataFrame:
    """KN4: positive share, nearest distance; a tie is negative."""
    g = neighbours.groupBy("q").agg(F.avg(positive.cast("int")).alias("fraction"), F.min("d").alias("nearest"))
    return g.withColumn("pred", F.when(F.col("fraction") > 0.5, "positive").otherwise("negative"))


def mean_vector(vectors: DataFrame, *keys: str) -> DataFrame:
    """Element-wise mean of ``v`` by key, as an array."""
    at = vectors.select(*keys, F.posexplode("v").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    rows = at.groupBy(*keys) if keys else at.groupBy()
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def percentile_below(scores: DataFrame, value: str, calibration: DataFrame, x: str) -> DataFrame:
    """KN5's percentile: the share of calibration values strictly below each score.  Values are counted once per
    distinct value, and a running sum over the distinct values of both sides gives every score its place."""
    known = _checkpoint(calibration.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
    total = F.lit(known.agg(F.sum("__n")).first()[0])
    asked = scores.select(F.col(value).alias("__v")).where("__v is not null").distinct().withColumn("__n", F.lit(0))
    merged = _checkpoint(asked.unionByName(known).groupBy("__v").agg(F.sum("__n").alias("__n")))
    below = before(merged, ["__v"], "__below", "__n").select("__v", (F.col("__below") / total).alias("percentile"))
    return scores.join(below, F.col(value) == F.col("__v"), "left").drop("__v")
