"""The Merkle manifest against a recursive version of its definition."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from latticework.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, pos long, size long, root string, witness string, key string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, pos):
    out = []
    for level in tree[:-1]:
        out.append((level[pos ^ 1] if pos ^ 1 < len(level) else "", bool(pos & 1)))
        pos //= 2
    return out


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def expected(rows):
    low = lambda v: (v is not None, v if v is not None else 0)
    name = lambda r: (r[2] is not None, (r[2] or "").encode())
    trees = [(k, sorted(g, key=lambda r: (low(r[0]), bytes.fromhex(leaf(r))))) for k, g in groupby(sorted(rows, key=name), name)]
    whole = levels([levels([leaf(r) for r in g])[-1][0] for _, g in trees])
    out = []
    for t, (_, members) in enumerate(trees):
        tree = levels([leaf(r) for r in members])
        for pos, r in enumerate(members):
            out.append((r[0], r[2], leaf(r), tree[-1][0], whole[-1][0], siblings(tree, pos) + siblings(whole, t)))
    return out


def rows_of(counts):
    n = 0
    for lang, count in counts.items():
        for k in range(count):
            n += 1
            yield (n * 7919 % 10007, ["web", None, "é"][k % 3], lang, [None, k][k % 5 > 0], [None, "", f"text {k} ß"][min(2, k % 7)], *["x"] * 2, 1, 2, "r", "w", "k")


@pytest.mark.parametrize("size", [1, 8])
def test_manifest(spark, monkeypatch, size):
    monkeypatch.setattr(merkle, "K", size)
    data = [*rows_of({None: 3, "": 1, "en": 600, "é": 257 if size > 1 else 33, "z": 2})]
    data += [data[5], data[5], (None, *data[9][1:]), (None, *data[9][1:])]  # rows that repeat, rows without an id
    if size == 1:
        data = data[:90] + data[-37:]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = merkle.merkle_manifest(df).withColumn("folded", merkle.fold(F.col("claim"), F.col("witness"))).collect()
    key = lambda r: repr((r[0], r[1], r[2], r[5]))
    assert sorted([(r.doc_id, r.tree, r.leaf, r.subroot, r.root, [(s.digest, s.left) for s in r.witness]) for r in got], key=key) == sorted(expected(data), key=key)
    assert {r.folded for r in got} == {r.root for r in got} and len({r.root for r in got}) == 1


def test_claims_and_edges(spark):
    one = spark.createDataFrame([(1, None, None, 4, "x" * 300_000, *["x"] * 2, 1, 2, "r", "w", "k")], SCHEMA)
    (row,) = merkle.merkle_manifest(one, {"n_chars": F.lit(5)}).withColumn("folded", merkle.fold(F.col("claim"), F.col("witness"))).collect()
    assert row.root == row.subroot == row.leaf != row.claim == row.folded and row.witness == []
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tampered_rows(spark, sf_dir):
    import zlib

    for r in merkle.op13_merkle_manifest(spark, sf_dir).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)


def test_appender_extends_open_subtrees():
    block = merkle.Appender()
    for k in range(3):
        block.append(str(k))
    assert block.witnesses == [[("1", False)], [("0", True)], []]  # partial: the subtree of two waits for its sibling
    block.append("3")
    assert block.witnesses[0] == [("1", False), (H("2", "3"), False)] and block.close(0) == levels(list("0123"))[-1][0]
