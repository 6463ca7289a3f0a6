"""Personal data: base spans against the patterns themselves, messages against enumeration, consistency in documents."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from latticework.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]
SCHEMA = "doc_id long, text string, base string, added string, nodes string, spans string, lang string"


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    keep = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if keep[k](m[0]))


def line(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "4", "255", "256", "00", "a", "ab.c", "x@y.z", "é", "𝟙", "１", "4111 1111 1111 1111", "4111111111111111", "+1 (663) 555-6869", "10.2.3.4", "\n", "_", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_runs_take_no_longer_than_their_length():
    n = 300_000
    for text in ("a" * n, "a@" * (n // 2), "1" * n, "1." * (n // 2), "+1" + " " * n, "1 " * (n // 2), "(at)" * (n // 4), "a(at)" * (n // 5)):
        base = pii.base_spans(text)
        pii.nodes_of(text, base)  # ends


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    unary, edges = rng.normal(size=(5, 3)), [(0, 1, rng.normal(size=(3, 3))), (1, 2, rng.normal(size=(3, 3))), (1, 3, rng.normal(size=(3, 3))), (3, 4, rng.normal(size=(3, 3)))]
    want = np.zeros((5, 3))
    for labels in itertools.product(range(3), repeat=5):
        w = np.exp(sum(unary[k, v] for k, v in enumerate(labels)) + sum(p[labels[a], labels[b]] for a, b, p in edges))
        for k, v in enumerate(labels):
            want[k, v] += w
    np.testing.assert_allclose(pii.beliefs(unary, edges), want / want.sum(axis=1, keepdims=True), atol=1e-7)


TEXTS = {
    1: "call +1 (663) 555-6869 now; or (663) 555-6869 or 1-663-555-6869",
    2: "mail jane.doe@mail2.example.com, that is JANE.DOE (at) mail2 (dot) example (dot) com",
    3: "card 4111 1111 1111 1111 and again 4111 1111 1111 1112 4111 1111 1111 1111",
    4: "no personal data: order 663 555 68691, part 4111 1111 1111 1112, host at work",
    5: "host 10.20.30.40 and 10.20.30.400",
    6: "call +1 (663) 555-6869 but order 7788990011 is none",
    7: None, 8: "", 9: "jane (at) mail (dot) com",
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, t, "x", "x", "x", "x", "en") for k, t in TEXTS.items()] + [(None, TEXTS[1], *"xxxxx"), (1, TEXTS[1], *"xxxxx")], SCHEMA).repartition(3)
    return [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.added]) for r in pii.find_personal_data(df).collect()]


def test_consistency_within_documents(found):
    assert len(found) == len(TEXTS) + 2
    added = {}
    for doc, base, more in found:
        text = TEXTS[doc or 1] or ""
        assert base == brute(text)
        added.setdefault(doc, []).append([(pii.KINDS[k], text[a:b]) for a, k, b in sorted(more)])
    assert added[1] == [[("phone", "(663) 555-6869"), ("phone", "1-663-555-6869")]] * 2 and added[None] == added[1][:1]
    assert added[2] == [[("email", "JANE.DOE (at) mail2 (dot) example (dot) com")]]
    assert added[4] == added[6] == added[7] == added[8] == added[9] == [[]]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op12_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert set(line(base).split(",")) <= set(r.spans.split(","))
        if not base:
            assert r.spans == ""


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
