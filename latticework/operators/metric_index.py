"""Exact k nearest references through pivots: cells, distance bands and bounds that shrink.

References belong to the Voronoi cell of the nearest of some pivots (references themselves, by hash).  A query first
searches its own cell; the k-th distance found there is its bound.  Another cell is visited only if

* the nearest point that its radius allows is within the bound:  d(q, p) - radius <= bound, and
* the bisector of both pivots is:  (d(q, p) - d(q, home)) / 2 <= bound,

and inside a visited cell only references in the band |d(q, p) - d(x, p)| <= bound meet the query.  Cells are dealt into
blocks of a bounded number of references and of queries, so neither a large cell nor a popular one is one task.  Each
block keeps its k best of each query.

How much this saves depends on the vectors: where they fall into groups most cells are never visited; where all
distances are alike (independent directions in many dimensions) no bound of this kind excludes anything, and every
query meets every cell.  The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _checkpoint

#: Most pivots (the square root of the references up to there), rows of a block, and a margin for rounding.
PIVOTS, BLOCK, MARGIN = 1024, 4096, 1e-9
#: Rough distances that are held at once.
CELLS = 1 << 20


def best(q: np.ndarray, qv: np.ndarray, above: np.ndarray | None, r: np.ndarray, rv: np.ndarray, k: int, leave_self: bool, allowed: np.ndarray | None = None, bound: np.ndarray | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, distance) of the k nearest references in a block for each query.  One matrix product finds
    who can be among them; their distances are then taken from the differences.  Queries are passed over that have no
    reference within their ``bound``.  ``names`` stand for the queries in the result."""
    at, ids, far = [], [], []
    qs, rs = (qv**2).sum(axis=1), (rv**2).sum(axis=1)
    step = max(1, min(256, CELLS // max(1, len(r))))
    for lo in range(0, len(q), step):
        rough = qs[lo : lo + step, None] + rs[None] - 2 * (qv[lo : lo + step] @ rv.T)
        slack = 1e-9 * (1 + qs[lo : lo + step, None] + rs[None])
        some = np.ones(len(rough), bool)
        if bound is not None:
            may = ~(rough - slack > (bound[lo : lo + step] * (1 + MARGIN))[:, None] ** 2)
            if above is not None:
                may &= ~((rough + slack <= above[lo : lo + step, None] ** 2) & (above[lo : lo + step, None] >= 0))
            some = may.any(axis=1)
        for n in np.flatnonzero(some) + lo:
            d2, room = rough[n - lo], slack[n - lo]
            ok = np.ones(len(r), bool) if allowed is None else allowed[n].copy()
            if leave_self:
                ok &= r != q[n]
            sure = ok
            if above is not None:
                floor = above[n] ** 2 if above[n] >= 0 else above[n]
                ok, sure = ok & (d2 + room > floor), ok & (d2 - room > floor)
            c = np.flatnonzero(ok)
            if (low := np.flatnonzero(sure)).size > k:
                c = c[d2[c] <= np.partition(d2[low], k - 1)[k - 1] + 2 * room.max()]
            d = np.sqrt(((rv[c] - qv[n]) ** 2).sum(axis=1))
            if above is not None:
                c, d = c[d > above[n]], d[d > above[n]]
            order = np.lexsort((r[c], d))[:k]
            at.append(np.full(len(order), q[n] if names is None else names[n]))
            ids.append(r[c][order])
            far.append(d[order])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (at, ids, far))


def nearer(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among (query, reference, distance), by query, distance and reference."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    at = np.arange(len(q))
    kept = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return q[kept], ids[kept], d[kept]


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _homes(pivots: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _to_pivots(_rows(b), pivots)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], [*b.schema.names, "cell", "dp"])

    return run


def _visits(pivots: np.ndarray, radius: np.ndarray):  # noqa: ANN202
    """The cells beyond its own that a query has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d, home, bound = _to_pivots(_rows(b), pivots), b.column("cell").to_numpy(), b.column("bound").to_numpy()[:, None]
            own = d[np.arange(len(d)), home][:, None]
            reach = bound + MARGIN * (1 + d)
            open_ = (d - radius[None] <= reach) & ((d - own) / 2 <= reach) & (radius[None] >= 0)
            open_[np.arange(len(d)), home] = False
            at, cell = np.nonzero(open_)
            for lo in range(0, len(at), 4096):
                part = b.take(pa.array(at[lo : lo + 4096])).select(["id", "v", "above", "bound"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[lo : lo + 4096].astype(np.int32)), pa.array(d[at[lo : lo + 4096], cell[lo : lo + 4096]])], ["id", "v", "above", "bound", "cell", "dp"])

    return run


_FOUND = "q long, id long, d double"


def _searched(visits: DataFrame, refs: DataFrame, sizes: dict[int, int], k: int, leave_self: bool, floor: bool, compared: Accumulator | None) -> DataFrame:
    """The k nearest of each visit's cell; cells are dealt into blocks of both sides."""
    counts = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell at most
    parts = {r.cell: (-(-r.n // BLOCK), -(-sizes.get(r.cell, 0) // BLOCK)) for r in counts if sizes.get(r.cell, 0)}
    if not parts:
        return visits.sparkSession.createDataFrame([], _FOUND)
    table = visits.sparkSession.createDataFrame([(c, q, r) for c, (q, r) in parts.items()], "cell int, qs int, rs int")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(F.broadcast(table), "cell").withColumn("qb", salt("qs")).withColumn("rb", every("rs")).drop("qs", "rs")
    right = refs.join(F.broadcast(table), "cell").withColumn("rb", salt("rs")).withColumn("qb", every("qs")).drop("qs", "rs")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "id": [], "d": []}).astype({"q": "int64", "id": "int64"})
        dp = a["dp"].to_numpy()[:, None]
        band = np.abs(dp - b["dp"].to_numpy()[None]) <= a["bound"].to_numpy()[:, None] + MARGIN * (1 + dp)
        if compared is not None:
            compared.add(int(band.sum()))
        got = best(a["id"].to_numpy(), np.stack(a["v"]), a["above"].to_numpy(float) if floor else None, b["id"].to_numpy(), np.stack(b["v"]), k, leave_self, band)
        return pd.DataFrame(dict(zip(["q", "id", "d"], got, strict=True))).astype({"q": "int64", "id": "int64"})

    return left.groupBy("cell", "qb", "rb").cogroup(right.groupBy("cell", "qb", "rb")).applyInPandas(block, _FOUND)


def search(queries: DataFrame, refs: DataFrame, k: int, leave_self: bool, floor: bool, n: int, compared: Accumulator | None = None) -> DataFrame:
    """q, id, d: the k nearest references of each query, at least.  queries, refs: id, v, above (with ``floor``, only
    references farther than a query's count); n references.  ``compared`` counts the pairs whose vectors met."""
    chosen = refs.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, int(n**0.5)))).select("v").toArrow().combine_chunks()
    if not chosen.num_rows:
        return refs.sparkSession.createDataFrame([], _FOUND)
    pivots = np.unique(np.array(chosen.column("v").to_pylist(), float), axis=0)
    shape = "id long, v array<double>, above double, cell int, dp double"
    dealt = _checkpoint(refs.mapInArrow(_homes(pivots), shape))
    cells = dealt.groupBy("cell").agg(F.max("dp").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row a pivot
    sizes, radius = {c.cell: c.n for c in cells}, np.full(len(pivots), -1.0)
    for c in cells:
        radius[c.cell] = c.r
    asked = _checkpoint(queries.mapInArrow(_homes(pivots), shape))
    home = _checkpoint(_searched(asked.withColumn("bound", F.lit(float("inf"))), dealt, sizes, k, leave_self, floor, compared))
    bounds = home.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.element_at(F.array_sort(F.collect_list("d")), k)).alias("bound"))
    bounded = asked.drop("dp").join(bounds.withColumnRenamed("q", "id"), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    visits = _checkpoint(bounded.select("id", "v", "above", "bound", "cell").mapInArrow(_visits(pivots, radius), "id long, v array<double>, above double, bound double, cell int, dp double"))
    return home.union(_searched(visits, dealt, sizes, k, leave_self, floor, compared))
