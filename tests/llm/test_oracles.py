"""Operators that SQL can express, against their SQL."""

import pytest

from latticework.llm.registry import ORACLE_SQL, QUERIES
from tests.test_oracles import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
