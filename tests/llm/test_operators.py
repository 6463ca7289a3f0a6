"""The training-data operators against brute force, on small fixtures with every awkward case."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from latticework.llm import bpe, common, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, quality, suffix_dedup, token_store, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, x string, score string"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    out = {0: None, 1: "", 2: " \n\t ", 3: "one two three", 4: "ONE two three", 5: base, 6: base.upper(), 7: base + " extra", 8: base.replace(" ", "\n", 3), 9: prose(30) + " " + base}
    near = base.split(" ")
    for k in range(10, 40):  # a large group of near copies
        w = near.copy()
        w[rng.randrange(60)] = f"edit{k}"
        out[k] = " ".join(w)
    passage = prose(40)
    for k in range(40, 70):  # a passage that many share
        out[k] = prose(rng.randint(5, 30)) + " " + passage + " " + prose(rng.randint(5, 30))
    out[70] = "a" * 500
    out[71] = "word " * 300
    out[72] = prose(9000)
    out[73] = "<|endoftext|> x<|startoftext|>y   tail   \r\n\r\n end 12345 don't WE'LL    İ Σσ é"
    out[74] = " " * 3000 + "z" + "\n" * 500
    out[75] = out[72]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, ["en", "de", None][k % 3], "s", 1, "k", "r", "x", "s") for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without ids, and rows that repeat an id."""
    long = "some words that go on for more than one hundred bytes so that the suffix operator has work to do here, twice over"
    rows = [(None, long), (None, None), (5, long), (5, long), (5, "other text"), (None, long + "!")]
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")


def shingles(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def roots(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {k: (k, len(sets[k]), label[k]) for k in texts}


def test_jaccard_join(docs, texts):
    assert {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()} == roots(texts)


def test_jaccard_join_links_rows_without_ids(spark):
    """A near copy without an id ties two documents that are not linked with each other; others have no id at all."""
    words = [f"w{k}" for k in range(104)]
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    lone = " ".join(f"v{k}" for k in range(60))
    far = changed(10, 20), changed(50, 60), changed()
    assert roots({5: far[0], 9: far[1]})[9][2] == 9 and roots({5: far[0], 7: far[2], 9: far[1]})[9][2] == 5
    rows = [(5, far[0]), (None, far[2]), (9, far[1]), (None, lone), (None, lone + " more"), (None, None), (None, "  ")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1)] * 4 + [(-1, 5), (5, 5), (9, 5)]
    names = [r.component for r in got if r.component is not None]
    assert len(names) == 5 and len(set(names)) == 2


def test_jaccard_join_recurses(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "FREQUENT_IN_TASK", 1 << 30)  # no order by frequency: regions stay hot
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()} == roots(texts)


def families(rng, n):
    """Near copies of a few texts that all begin with one passage; some copies are near none."""
    words = [f"w{k}" for k in range(5000)]
    passage = [rng.choice(words) for _ in range(25)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    out = {}
    for k in range(n):
        w = passage + bases[k % 6]
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            w[rng.randrange(25, 85)] = rng.choice(words)
        out[k] = " ".join(w)
    return out


def test_jaccard_join_deals_cells(spark, monkeypatch):
    """Families in one region: documents go to the cells of near pivots, the triangle inequality rules pairs out,
    and the links are those of brute force."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 6)
    monkeypatch.setattr(jaccard_join, "FREQUENT_IN_TASK", 1 << 30)
    apart, splits = [], []
    meet, deal = jaccard_join._meet, jaccard_join._deal

    def met(left, pivots):
        j = left.join(pivots, "region").where((left["x"] != pivots["p"]) & (left["component"] != pivots["pc"]))
        apart.append(j.where(jaccard_join._apart("lo", "hi", "plo", "phi")).count())
        return meet(left, pivots)

    def dealt(left, *rest):
        out = deal(left, *rest)
        splits.append((left.select("region").distinct().count(), out.select("region").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "_meet", met)
    monkeypatch.setattr(jaccard_join, "_deal", dealt)
    every = families(random.Random(4), 90)
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == roots(every)
    print("pairs that the triangle inequality ruled out:", apart, "regions before and after dealing:", splits)
    assert sum(apart) > 0 and any(b > a for a, b in splits)


def test_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for n, common in ((3, 1), (40, 30), (400, 310), (5000, 100)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[:common], rng.integers(0, 1 << 63, n // 5 + 1, dtype=np.uint64)])
        a, b = (jaccard_join.sketch(np.unique(s)).view(np.uint64) for s in (x, y))
        while len(a) != len(b):
            if len(a) > len(b):
                a, b = b, a
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        assert sum(int(w).bit_count() for w in a ^ b) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_exact_dedup(docs, texts):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[low(t)].append(k)
    for r in exact_dedup.exact_dedup(docs).collect():
        g = groups[low(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256(low(texts[r.doc_id]).encode()).hexdigest())


def brute_windows(texts, items):
    def words(t):
        return decontaminate.words_of(t)

    out = {}
    for k, t in texts.items():
        w, hit, found = words(t), set(), []
        for i, it in items:
            iw = words(it)
            n = min(10, len(iw))
            wins = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)} if iw else set()
            at = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in wins] if wins else []
            if at:
                found.append(str(i))
            hit |= {p for j in at for p in range(j, j + n)}
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate(spark, docs, texts):
    items = [(1, texts[5]), (2, " ".join(texts[72].split()[50:75]).upper()), (10, "One, TWO: three!"), (3, None), (4, "..."), (12, "nothing like this occurs here at all in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(texts, items)
    for limit in (1 << 20, 300, 80):  # one block; several; items longer than a block
        for r in decontaminate.decontaminate(docs, bench, limit=limit).collect():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
            cut = [decontaminate.words_of(texts[r.doc_id][s.begin : s.end]) for s in r.spans]
            assert sum(map(len, cut)) == r.n_hit
    none = decontaminate.decontaminate(docs, bench.where("false")).where("contaminated or n_items > 0")
    assert none.isEmpty()


def test_pieces_hold_the_windows():
    rng = random.Random(6)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "bcd", "éé", "x" * 9]) for _ in range(rng.randint(1, 60)))
        parts = list(decontaminate.pieces(text, 10, rng.randint(1, 200)))
        assert {w for p in parts for w in decontaminate.windows_of(decontaminate.words_of(p))} == set(decontaminate.windows_of(decontaminate.words_of(text)))


def test_language_id(spark, sf_dir):
    d = common.table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in language_id.identify(d).collect()}
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [k for k, r in got.items() if r.held_out]
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.95 * len(held)


def bayes(rows, orders=language_id.ORDERS, buckets=language_id.BUCKETS):
    """Naive Bayes with counts in dictionaries, one n-gram at a time: (language, posterior) of each text."""

    def grams(text):
        s = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()] + [32] * max(orders)
        for n in orders:
            for k in range(len(s)):
                if s[k] != 32:
                    h = n
                    for c in s[k : k + n]:
                        h = (h * 0x9E3779B97F4A7C15 + c * 0xC2B2AE3D27D4EB4F) % (1 << 64)
                    yield ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 40) % buckets

    counts, seen = defaultdict(Counter), Counter()
    for k, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(k).encode()) % 4 != 2:
            counts[lang].update(grams(text))
            seen[lang] += 1
    out = {}
    for k, text, _ in rows:
        log_p, bag = {}, Counter(grams(text))
        for lang in sorted(seen):
            total = sum(counts[lang].values()) + language_id.SMOOTHING * buckets
            log_p[lang] = np.log(seen[lang] / sum(seen.values())) + sum(n * np.log((counts[lang][g] + language_id.SMOOTHING) / total) for g, n in bag.items())
        best = max(log_p, key=log_p.get)
        out[k] = (best, 1 / sum(np.exp(v - log_p[best]) for v in log_p.values())) if bag else ("und", 0.0)
    return out


def test_language_id_is_naive_bayes(docs, texts, monkeypatch):
    want = bayes([(k, t, ["en", "de", None][k % 3]) for k, t in texts.items()])
    for gather in (language_id.GATHER, 64):  # long texts go over several gathers
        monkeypatch.setattr(language_id, "GATHER", gather)
        got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
        assert got.keys() == want.keys()
        for k, (lang, p) in want.items():
            assert got[k][0] == lang and abs(got[k][1] - p) < 1e-6, k


def test_language_id_ties_go_to_the_first_name(spark):
    rows = spark.createDataFrame([(k, "the same words", lang) for k, lang in ((0, "y"), (1, "x"), (3, "x"), (4, "y"))], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    assert {(r.lang_pred, round(r.score, 9)) for r in language_id.predict(rows, model).collect()} == {("x", 0.5)}


def test_language_id_without_letters(spark, docs, empty):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("lang is null")).collect()} == {"und"}


def test_bpe(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_takes_very_long_runs():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c = Tokenizer.from_file(path), bpe.codec(path)
    for x in (" " * 2_000_000 + "z", "a " + " " * 4999 + "b", "\n" * 60_000, "ab" * 50_000):
        raw = np.frombuffer(x.encode(), np.uint8)
        assert c.encode_all(raw, np.array([0, len(raw)]))[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_bpe_small_chunks_agree(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c = Tokenizer.from_file(path), bpe.Codec(path, chunk_bits=3)
    for x in texts.values():
        raw = np.frombuffer((x or "").encode(), np.uint8)
        (ids,) = c.encode_all(raw, np.array([0, len(raw)]))
        assert ids.tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_token_store(spark, docs, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_store.write_tokens(docs, path, folder, shard_tokens=2000)
    got = {r.doc_id: r for r in token_store.read_tokens(spark, folder, manifest).collect()}
    at = 0
    for k in sorted(texts):
        ids = [*t.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("high", [1, 2, 50_000, 1 << 32])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 1023, 1024, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 4_000_000_000
        data = token_store.shard_bytes([7], [ids])
        docs, back = token_store.read_shard(data)
        assert back.tolist() == ids.tolist() and docs["n"].tolist() == [n]
        assert token_store.read_range(data, n // 3, n // 2).tolist() == ids[n // 3 : n // 3 + n // 2].tolist()


def test_warc(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 70_000), (None, "n", "lone"), (None, "n", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    folder = common.shared_dir(spark, "warc-test")
    index = warc.write_bundles(pages, folder, frame_bytes=2000, bundle_bytes=4000)
    got = warc.read_bundles(spark, folder, index).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [h or "" for p, _, h in rows if p == r.page_id and (r.page_id is not None or len((h or "").encode()) == r.payload_bytes)]
        raw = same[0].encode()
        best = max((p for p, _, h in rows if (h or "") == same[0] and p is not None), default=None)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == best else ("revisit", best))
    one = index.where("page_id = 5").first()
    data = open(common.tmp_path(folder) + "/" + one.bundle, "rb").read()
    assert warc.read_record(data, one.frame, one["at"])[1] == b"x" * 70_000


def test_lost_files_are_errors(spark, docs, tmp_path):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/tokens"
    manifest = token_store.write_tokens(docs, path, folder, shard_tokens=2000)
    (tmp_path / "tokens" / manifest.first()["name"]).unlink()
    with pytest.raises(Exception, match="shard of the manifest is missing"):
        token_store.read_tokens(spark, folder, manifest).collect()
    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(60)], "page_id long, url string, html string")
    index = warc.write_bundles(pages, f"file://{tmp_path}/warc", frame_bytes=100, bundle_bytes=500)
    (tmp_path / "warc" / index.first()["bundle"]).unlink()
    with pytest.raises(Exception, match="record of the index is missing"):
        warc.read_bundles(spark, f"file://{tmp_path}/warc", index).collect()


def brute_suffix(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(docs, texts, monkeypatch):
    want = brute_suffix(texts)
    for large in (512, 0):
        monkeypatch.setattr(suffix_dedup, "LARGE", large)
        for r in suffix_dedup.suffix_dedup(docs).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_suffix_moves_little(spark, monkeypatch):
    """Of texts that have some words in common by chance hardly any occurrence is open, and texts without rows stay
    where they are."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    every = {k: " ".join(rng.choice(words) for _ in range(80)) for k in range(300)}
    every |= {300 + k: every[k] + " and more" for k in range(10)}
    sizes, moved = {}, []
    cut, having = suffix_dedup.cut, suffix_dedup._having

    def counted(df, name):
        out = cut(df, name)
        sizes[name] = out.where("kind = 2").count()
        return out

    def watched(*frames):
        out = having(*frames)
        moved.append(tuple(x.count() for x in out))
        return out

    monkeypatch.setattr(suffix_dedup, "cut", counted)
    monkeypatch.setattr(suffix_dedup, "_having", watched)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_suffix(every)
    print("open occurrences:", sizes["anchors"], "texts that travel and that stay:", moved)
    assert sizes["anchors"] < 100 and all(sum(m) == len(every) and m[0] < 60 for m in moved) and len(moved) == 2


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        t = [rng.randint(1, rng.choice((1, 2, 20))) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_license_scan(spark, texts):
    notes = {k: f"{texts[5]} {v} {texts[3]}" for k, v in enumerate(license_scan.TEMPLATES.values())}
    rows = [*notes.items(), (90, None), (91, ""), (92, "Released"), (93, "released under some other licence"), (94, texts[72] + " All rights reserved."), (None, "All rights reserved")]
    got = defaultdict(set)
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add((r.license, r.containment))
    assert dict(got) == {k: {(name, 1.0)} for k, name in enumerate(license_scan.TEMPLATES)} | {94: {("all-rights-reserved", 1.0)}, None: {("all-rights-reserved", 1.0)}}


def test_license_scan_short_templates_and_chunks(spark, texts, monkeypatch):
    """Templates of one and two words; any cut of texts and of templates gives the same rows."""
    notes = {"one": "MIT", "two": "MIT License.", "other": "zlib", **license_scan.TEMPLATES}
    rows = [(1, "the MIT license"), (2, "permit MIT, or License"), (3, "ZLIB"), (4, None), (5, ""), (6, "mit"), (7, texts[72] + " mit license " + texts[72])]
    rows += [(8, " ".join(license_scan.TEMPLATES.values()) * 9), (9, texts[72] + " " + license_scan.LONG["mit-text"] + " " + texts[72])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scan = lambda: sorted((r.doc_id, r.license, r.containment, r.word) for r in license_scan.license_scan(df, notes | license_scan.LONG).collect())
    want = scan()
    assert {r[:3] for r in want if r[0] < 8} == {(1, "one", 1.0), (1, "two", 1.0), (2, "one", 1.0), (3, "other", 1.0), (6, "one", 1.0), (7, "one", 1.0), (7, "two", 1.0)}
    assert {r[1] for r in want if r[0] == 8} >= set(license_scan.TEMPLATES) and (9, "mit-text", 1.0) in {r[:3] for r in want}
    monkeypatch.setattr(license_scan, "CHUNK", 5)
    monkeypatch.setattr(license_scan, "MAX_TEMPLATES", 4)
    assert scan() == want


def test_license_scan_takes_time_in_proportion(spark):
    notices = " ".join(license_scan.TEMPLATES.values())
    seconds = []
    for times in (150, 150, 1500):  # the first run compiles; then 9,000 and 90,000 words
        df = spark.createDataFrame([(1, (notices + " ") * times)], "doc_id long, text string")
        began = time.time()
        assert license_scan.license_scan(df, license_scan.TEMPLATES | license_scan.LONG).count() >= 7
        seconds.append(time.time() - began)
    assert seconds[2] < 14 * seconds[1] + 5, seconds


def test_license_scan_long_texts(spark, texts):
    words = {k: v.split() for k, v in license_scan.LONG.items()}
    mit = words["mit-text"]
    rows = [(k, f"{texts[72]} {' '.join(w)} {texts[5]}") for k, w in enumerate(words.values())]
    rows += [(10, " ".join(mit[:80] + ["some", "added", "words"] + mit[80:])), (11, " ".join(mit[:60])), (12, " ".join(mit[30:]))]
    got = defaultdict(dict)
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.LONG).collect():
        got[r.doc_id][r.license] = r.containment
    assert {k: v for k, v in got.items() if k < 10} == {k: {name: 1.0} for k, name in enumerate(words)}
    assert set(got) == {0, 1, 2, 10, 12} and 0.97 < got[10]["mit-text"] < 1 and 0.75 < got[12]["mit-text"] < 0.9


def test_quality(spark, sf_dir):
    truth = {r.doc_id: r.quality for r in common.table(spark, sf_dir, "labels").collect()}
    got = {r.doc_id: r.good for r in quality.classify(common.table(spark, sf_dir, "documents")).collect()}
    assert sum(got[k] == bool(q) for k, q in truth.items()) >= 0.9 * len(truth)


def labelled(text):
    """Votes of one text by the labellers' definitions, and its words' features, one word at a time."""
    words = (text or "").encode().split()
    n = len(words)
    shapes, features = [], Counter()
    for w in words:
        kinds = {0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 13 if c > 127 else b".,!#$%&*|".index(c) + 3 if c in b".,!#$%&*|" else 12 for c in w}
        shapes.append(kinds)
        features[sum(1 << k for k in kinds)] += 1
        features[(1 << 14) + int(common.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) // (1 << 40) % quality.WORD_BUCKETS] += 1
    low = [w.lower() for w in words]
    again = [k > 0 and low[k] == low[k - 1] for k in range(n)]
    features[quality._SIZE - 2] += sum(again)
    upper = [1 in s and 0 not in s and len(w) > 2 for s, w in zip(shapes, words, strict=True)]
    odd = [bool(s & set(range(5, 12))) for s in shapes]
    share = lambda x: sum(map(bool, x)) / max(n, 1)
    size = min(quality.WINDOW, n)
    parts = [low[min(k, n - size) :][:size] for k in range(0, n, size or 1)]
    variety = sum(len(set(p)) / size for p in parts) / len(parts) if n >= 40 else 1
    bad = [share(s & set(range(6, 11)) for s in shapes) > 0.2, share(again) > 0.2, share(upper) > 0.3, variety < 0.2, share(5 in s for s in shapes) > 0.2, share(11 in s for s in shapes) > 0.2]
    stops, plain = share(3 in s for s in shapes), share(not (a or b or c) for a, b, c in zip(upper, odd, again, strict=True))
    votes = [0 if b and n >= 5 else -1 for b in bad] + [1 if 0.02 < stops < 0.5 and plain > 0.8 else -1, 1 if plain > 0.9 else 0 if plain < 0.6 and n >= 5 else -1]
    return (votes if n else [-1] * 8), {k: v for k, v in features.items() if v}, n


def test_quality_is_em_and_a_logistic_scorer(spark, texts):
    rng = random.Random(9)
    more = [" ".join(rng.choice(["Fine words.", "plain", "text", "SHOUT", "##", "a|b", "wow!", "same same same", "x,"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    given = {k: t for k, t in [*texts.items(), *((100 + k, t) for k, t in enumerate(more))]}
    known = {k: labelled(t) for k, t in given.items()}
    # EM over the documents themselves, one at a time.
    post = {k: 1 / (1 + np.exp(-(v.count(1) - 2.0 * v.count(0)))) for k, (v, _, _) in known.items()}
    for _ in range(quality.ROUNDS):
        prior = sum(post.values()) / len(post)
        p = {(c, j, v): 0.5 for c in (0, 1) for j in range(8) for v in (-1, 0, 1)}
        for k, (votes, _, _) in known.items():
            for j, v in enumerate(votes):
                p[1, j, v] += post[k]
                p[0, j, v] += 1 - post[k]
        sums = {(c, j): sum(p[c, j, v] for v in (-1, 0, 1)) for c in (0, 1) for j in range(8)}
        for k, (votes, _, _) in known.items():
            odds = np.log(prior / (1 - prior)) + sum(np.log(p[1, j, v] / sums[1, j]) - np.log(p[0, j, v] / sums[0, j]) for j, v in enumerate(votes))
            post[k] = 1 / (1 + np.exp(-min(max(odds, -50), 50)))
    # Adagrad over dictionaries, on the documents with a vote.
    taught = [k for k in sorted(known) if set(known[k][0]) != {-1}]
    assert 50 < len(taught) < len(known)
    bag = {k: {**{b: float(np.float32(c / max(1, n))) for b, c in f.items()}, quality._SIZE - 1: 1.0} for k, (_, f, n) in known.items()}
    w, seen, order = defaultdict(float), defaultdict(lambda: 1e-3), np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for at in order.permutation(len(taught)):
            x = bag[taught[at]]
            slope = 1 / (1 + np.exp(-sum(w[b] * v for b, v in x.items()))) - post[taught[at]]
            for b, v in x.items():
                g = slope * v + quality.DECAY * w[b]
                seen[b] += g * g
                w[b] -= quality.STEP * g / np.sqrt(seen[b])
    rows = [(k, t) for k, t in given.items()]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == given.keys()
    for k, r in got.items():
        score = 1 / (1 + np.exp(-sum(w[b] * v for b, v in bag[k].items()))) if known[k][2] else 0.0
        assert abs(r.p_weak - post[k]) < 1e-6 and abs(r.score - score) < 1e-4 and r.good == (r.score >= 0.5), k


def test_quality_repeated_rows_teach_once(spark, texts):
    rows = [(k, t) for k, t in texts.items()]
    one, many = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows + [(40, texts[40])] * 50))
    # The vote histogram counts every row; the sample holds each document once.
    assert quality.classify(many).count() == len(rows) + 50
    assert quality.classify(one, sample=5).count() == len(rows)


def test_quality_variety_counts_every_word():
    rng = random.Random(5)
    varied = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    same = lambda n: " ".join(["one two"] * (n // 2))
    texts = [varied(400) + " " + same(4000), same(400) + " " + varied(4000), varied(399), same(50), varied(30) + " " + same(380)]
    raw = [t.encode() for t in texts]
    votes = quality.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0]
    assert votes[:, quality.LABELLERS.index("variety")].tolist() == [quality.BAD, quality.NONE, quality.NONE, quality.BAD, quality.BAD]


def test_quality_on_awkward_texts(docs, texts):
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert set(got) == set(texts) and got[0].score == got[1].score == 0.0


OPERATORS = {
    "jaccard": jaccard_join.jaccard_join, "exact": exact_dedup.exact_dedup, "suffix": suffix_dedup.suffix_dedup, "language": lambda d: language_id.predict(d, {"langs": [], "orders": (1,), "log_p": np.zeros((9, 0)), "log_prior": np.zeros(0)}),
    "identify": language_id.identify, "license": license_scan.license_scan, "quality": quality.classify, "bpe": lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"license"}))
def test_odd_ids_keep_their_rows(odd, name):
    assert Counter(r.doc_id for r in OPERATORS[name](odd).collect()) == {None: 3, 5: 3}


def test_empty_files(spark, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/t", token_store.write_tokens(empty, path, f"file://{tmp_path}/t")).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w").count() == 0


def test_suffix_rows_that_share_an_id(odd):
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(odd).collect())
    long = max(n for _, n, _ in got) - 1
    assert (False, long, long) in got and (True, 0, 0) in got


def test_suffix_many_rows_without_ids(spark):
    rng = random.Random(11)
    junk = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passages = [junk(150) for _ in range(5)]
    rows = [(None, junk(rng.randint(0, 250)) + rng.choice(passages) + junk(rng.randint(0, 60))) for _ in range(2500)]
    rows += [(7, junk(20 * k) + passages[k % 5]) for k in range(20)] + [(-(1 << 63), junk(30) + passages[0])]
    least: dict[bytes, tuple] = {}
    for i, t in rows:  # the earliest place of each string; rows of one id are one document
        b = t.encode()
        for j in range(len(b) - 99):
            at = (-(1 << 63) if i is None else i, j)
            least[b[j : j + 100]] = min(at, least.get(b[j : j + 100], at))
    want = Counter()
    for i, t in rows:
        b, gone = t.encode(), set()
        for j in range(len(b) - 99):
            if least[b[j : j + 100]] != (-(1 << 63) if i is None else i, j):
                gone.update(range(j, j + 100))
        want[(i, len(b), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest())] += 1
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r.doc_id, r.n_bytes, r.kept_sha256) for r in got.collect()) == want
