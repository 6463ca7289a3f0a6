"""Functions for SQL users: ``register(spark)`` makes them known to a session.

``point_distance(a, b)`` (GE1): Euclidean distance of two arrays of one length.
``superposition_error(p, q)`` (GE8): least root mean square error of p moved onto q by a rigid motion, no reflection;
points are arrays of three numbers.
``knn_vote(neighbours, k)`` (KN1): the most frequent label of the k nearest of an array of (d, id, label); of equals the
one that comes first by distance and id.  With ``collect_list`` it votes over whatever a query joined and grouped.

Distance and vote are SQL expressions that Catalyst inlines; only the superposition runs in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

DISTANCE = """
CREATE OR REPLACE TEMPORARY FUNCTION point_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))
"""
VOTE = """
CREATE OR REPLACE TEMPORARY FUNCTION knn_vote(neighbours ARRAY<STRUCT<d: DOUBLE, id: BIGINT, label: STRING>>, k INT) RETURNS STRING
RETURN element_at(array_sort(
    transform(array_distinct(transform(slice(array_sort(neighbours), 1, k), s -> s.label)),
        l -> named_struct('n', -size(filter(slice(array_sort(neighbours), 1, k), s -> s.label <=> l)),
                          'first', array_position(transform(slice(array_sort(neighbours), 1, k), s -> coalesce(s.label, '')), coalesce(l, '')), 'label', l))), 1).label
"""


def superposition_error(p: np.ndarray, q: np.ndarray) -> float:
    """NaN where there are no points or not as many in both."""
    if p.shape != q.shape or p.ndim != 2 or not len(p):
        return float("nan")
    p, q = p - p.mean(axis=0), q - q.mean(axis=0)
    u, s, vt = np.linalg.svd(p.T @ q)
    s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0
    return float(np.sqrt(max(0.0, ((p**2).sum() + (q**2).sum() - 2 * s.sum()) / len(p))))


def register(spark: SparkSession) -> None:
    """Null in, null out; so it is for points that do not pair up, and for no neighbours."""
    spark.sql(DISTANCE)
    spark.sql(VOTE)

    @pandas_udf("double")
    def error(p: pd.Series, q: pd.Series) -> pd.Series:
        made = (np.nan if a is None or b is None else superposition_error(np.array([*a], float), np.array([*b], float)) for a, b in zip(p, q, strict=True))
        return pd.Series([None if np.isnan(x) else x for x in made], dtype="float64")

    spark.udf.register("superposition_error", error)
