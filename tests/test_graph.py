"""Components over many rounds: what a round leaves behind does not grow."""

import random

from latticework.operators import graph


def test_components_of_a_chain(spark, monkeypatch):
    """A shuffled chain, a loop, an edge in both directions and one to nowhere: few rounds, and estimates of a table's size."""
    bits, cut = [], graph._checkpoint

    def counted(df):
        out = cut(df)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(graph, "_checkpoint", counted)
    chain = list(range(10, 74))
    random.Random(2).shuffle(chain)
    edges = [*zip(chain, chain[1:]), (1, 1), (2, 3), (3, 2), (4, 99)]
    ids = spark.createDataFrame([(i,) for i in [*chain, 1, 2, 3, 4, 4]], "id long")
    got = graph.components(ids, spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.id, r.component) for r in got) == sorted([(1, 1), (2, 2), (3, 2), (4, 4), *((i, 10) for i in chain)])
    assert max(bits) < 64 and len(bits) < 64


def test_components_without_edges(spark):
    ids = spark.createDataFrame([("b",), ("a",)], "id string")
    got = graph.components(ids, spark.createDataFrame([], "a string, b string")).collect()
    assert sorted((r.id, r.component) for r in got) == [("a", "a"), ("b", "b")]
