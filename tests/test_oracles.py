"""Every registered query against its SQL, on the smallest tables."""

import math

import pytest

from latticework.registry import ORACLE_SQL, QUERIES


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 4) + 0.0
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert got == rows(rel.columns, rel.fetchall())
    else:
        assert got[1]
