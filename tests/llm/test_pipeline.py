"""run() against the stages done by hand."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from latticework.llm import common
from latticework.llm.decontaminate import windows_of, words_of
from tests.llm.test_operators import roots


def test_run(spark, sf_dir):
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    kept = {k: t for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for k in sorted(kept):
        last[kept[k].translate({c: c + 32 for c in range(65, 91)})] = k
    kept = {k: kept[k] for k in last.values()}
    kept = {k: kept[k] for k, (_, _, root) in roots(kept).items() if k == root}
    wins = {w for r in common.table(spark, sf_dir, "benchmark").collect() for w in windows_of(words_of(r.text))}
    sizes = {len(w.split()) for w in wins}
    kept = {k: t for k, t in kept.items() if not any(w in wins for n in sizes if len(words_of(t)) >= n for w in windows_of(words_of(t), n))}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    for k, r in got.items():
        ids = t.encode(kept[k], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_stages_on_awkward_rows(spark, sf_dir):
    """Null ids, repeated ids and rows, null and empty texts, columns whose names a stage might use, and no rows."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, kept_id long, kept_rows long, __again int, component_id long, score double"
    text = "some words about nothing in particular that are long enough to make a few shingles of five words each"
    rows = [(None, text), (None, text.upper()), (None, None), (1, text), (1, text), (1, "another text of the same id"), (2, ""), (3, "  ,.  "), (4, text + " more"), (5, "lone letters"), (5, "LONE letters")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "r", 7, 7, 7, 7, 0.5) for i, t in rows], columns)
    for d in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = common.cut(stage(spark, d, sf_dir), name)
            assert d.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, d, sf_dir)
        got = sorted((r.doc_id, r.n_tokens > 0) for r in last.collect())
        assert got in ([(1, True), (1, True), (5, True)], [])


def test_exact_stage_keeps_rows_not_ids(spark, sf_dir):
    rows = [(None, "a b"), (None, "A B"), (None, "c"), (2, "c"), (3, "d"), (3, "D"), (3, "e")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text.lower()) for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect())
    assert got == [(0, "a b"), (2, "c"), (3, "d"), (3, "e")]


def test_near_copy_stage_keeps_rows_not_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(3, text), (None, text + " a"), (8, text + " b"), (3, other), (None, other + " a"), (None, "lone words of its own"), (None, None), (4, ""), (4, ""), (9, "p q r s t u"), (9, "p q r s t u")]
    rows += [(None, " ".join(f"u{k}" for k in range(60)) + end) for end in ("", " a", " b")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    free = [g for g in got if (g[1] or "").startswith("u0")]
    assert len(free) == 1 and free[0][0] is None
    want = [(3, text), (3, other), (None, "lone words of its own"), (None, None), (4, ""), (4, ""), (9, "p q r s t u")]
    assert sorted(map(repr, (g for g in got if g not in free))) == sorted(map(repr, want))
