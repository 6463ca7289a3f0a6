"""Ordered work without one task that sees every row: running sums, order statistics and digests of sorted rows.

A running sum cuts the order into buckets at bounds from a small sample (the bounds only balance the buckets; any
would give the same result), sums each bucket, and adds the sums before it to the running sum inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a running sum, at least; rows of one bucket, up to 256 buckets; rows sampled for their bounds.
BUCKETS, BUCKET_ROWS, SAMPLE = 32, 1 << 20, 4000


def before(df: DataFrame, order: list[str], name: str, value: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (by default the number) of the rows that come earlier in ascending
    ``order``, nulls first.  The order should have no ties; which of them counts as earlier is not defined."""
    n = df.count()
    rows = df.select(*order).dropna().sample(min(1.0, SAMPLE / max(n, 1)), seed=7).collect() if n > SAMPLE else []
    bounds = sorted({tuple(r) for r in rows})
    bounds = bounds[:: max(1, len(bounds) // max(BUCKETS, min(256, n // BUCKET_ROWS)))][1:]
    kinds = [df.schema[c].dataType for c in order]
    place = F.lit(0)
    for b in bounds:
        place = place + (F.struct(*order) >= F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, order, strict=True)))).cast("int")
    bucketed = df.withColumn("__bucket", place)
    one = F.col(value) if value else F.lit(1)
    sums = dict(bucketed.groupBy("__bucket").agg(F.sum(one)).collect())  # one row a bucket
    starts, total = [], 0
    for k in range(len(bounds) + 1):
        starts.append(total)
        total += sums.get(k) or 0
    inside = F.sum(one).over(Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.element_at(F.array(*(F.lit(x) for x in starts)), F.col("__bucket") + 1)
    return bucketed.withColumn(name, F.coalesce(inside, F.lit(0)) + start).drop("__bucket")


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, upper_median: the value at place n // 2 of each group's sorted values (nulls are left out).  Groups are
    never gathered: equal values are counted first, and places come from one running sum over groups and values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = before(counted, [key, value], "__at", "__n")
    groups = placed.groupBy(F.col(key).alias("__key")).agg(F.min("__at").alias("__first"), F.sum("__n").alias("__size"))
    at = F.col("__at") - F.col("__first")
    middle = F.floor(F.col("__size") / 2)
    found = placed.join(groups, F.col(key).eqNullSafe(F.col("__key"))).where((at <= middle) & (middle < at + F.col("__n")))
    return found.select(key, F.col(value).alias("upper_median"))


def sorted_digest(df: DataFrame, key: str, order: list[str], line: str, separator: str) -> DataFrame:
    """key, digest: SHA-256 of each group's lines in ascending ``order``, joined by ``separator``.  SHA-256 of a
    concatenation has to see it in order, so a group's lines - sorted by Spark, which spills - stream through one
    task; a task holds no more than one batch.  A null line counts as empty."""
    kind = df.schema[key].dataType
    rows = df.select(key, *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), F.coalesce(line, F.lit("")).alias("__line"))
    orders = [f"__o{k}" for k in range(len(order))]
    dealt = rows.repartition(key).sortWithinPartitions(key, *orders).select(key, "__line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, any_ = None, None, False
        arrow = None
        for b in batches:
            arrow = b.schema.field(0).type
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not any_ or k != held:
                    if any_:
                        yield pa.RecordBatch.from_arrays([pa.array([held], arrow), pa.array([state.hexdigest()])], [key, "digest"])
                    held, state, any_ = k, hashlib.sha256(x.encode()), True
                else:
                    state.update((separator + x).encode())
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([held], arrow), pa.array([state.hexdigest()])], [key, "digest"])

    return dealt.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("digest", T.StringType())]))
