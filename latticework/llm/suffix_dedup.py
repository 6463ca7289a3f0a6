"""Operator 9: suffix-array deduplication of repeated 100-byte strings.

Every 100-byte string of the corpus picks its *anchor*: the place in it where a 48-byte hash is least.  Equal
strings pick the same anchor, so strings can only repeat among occurrences of one anchor.  Neighbouring
strings share anchors; an occurrence stands for a run of them and for the text they cover, its context.

1. A task lists its occurrences.  Equal contexts within the task are settled at once (the later ones repeat),
   so each context leaves a task once, however often it occurs.
2. Occurrences are dealt by anchor.  Later equal contexts repeat; an anchor with several contexts is open.
3. Contexts of open anchors are read from the texts and cut into blocks of at most 27 strings with a common
   core of 74 bytes; blocks are dealt by core.  The different texts of a core are joined and suffix-sorted by
   linear grouping construction, and neighbours in the suffix array with 100 bytes in common are equal strings.
4. All strings but the first of each set give intervals to remove; documents meet their intervals by id.

What goes through shuffles decides how much disk the operator takes.  Anchors of 16 bytes are a few words, and in a
large corpus most occurrences have such an anchor in common with some other text; at 48 bytes few do by chance, which
is worth the larger number of occurrences (a string has 53 places for its anchor, not 85).  Blocks overlap, so the
places are halved and no more.  Texts travel to meet their rows in steps 3 and 4 only if a bitmap of the documents
that have rows says so.

The suffix array comes from grouping suffixes by first letter and then, from the greatest group to the least,
refining the groups of the previous smaller suffixes by how often the group points to them; each final group
shares a Lyndon prefix, and a last pass emits every group in order along the same pointers.  Python is too
slow to run it over every byte of a corpus, so it is kept for the texts of step 3, where sorting decides.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTES, bytes_of, cut, mix, powers, slices, table

#: Bytes of a repeated string, of an anchor, strings in a block, occurrences that a task holds at once, and
#: texts of one core beyond which equal strings are found by sorting them whole instead of all suffixes.
LENGTH, ANCHOR, BLOCK, HELD, LARGE = 100, 48, 27, 1 << 21, 512


# ---- suffix array


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last letter must be its only least one."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # where the suffix's group begins
    size = [0] * n  # by where a group begins
    begin = 0
    for k, s in enumerate(order):
        if text[s] != text[order[begin]]:
            begin = k
        place[s], group[s] = k, begin
        size[begin] += 1
    smaller = [-1] * n  # the nearest suffix before, of a lower group
    end = n - 1
    while end >= 0:
        begin = group[order[end]]
        members = order[begin : end + 1]
        if len(members) > 1:
            members.sort()
        seen: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                seen[p] = seen.get(p, 0) + 1
        end = begin - 1
        if not seen:
            continue
        by_count: dict[int, list[int]] = {}
        for p, c in seen.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[c]:
                moved.setdefault(group[p], []).append(p)
            for old, ps in moved.items():
                if len(ps) == size[old]:
                    continue
                last = old + size[old]
                for p in ps:  # to the end of the group's range
                    last -= 1
                    q, at = order[last], place[p]
                    order[at], order[last] = q, p
                    place[q], place[p] = at, last
                size[old] -= len(ps)
                size[last] = len(ps)
                for p in ps:
                    group[p] = last
    out = [-1] * n
    free = list(range(n))
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return out


def repeats(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Sets of at least two equal strings of ``length`` bytes, as (text, start)."""
    joined = b"".join(texts)
    letters: list[int] = []
    whose: list[tuple[int, int, int]] = []
    at = 0
    for k, t in enumerate(texts):
        letters.extend([b + 2 for b in t])
        letters.append(1)
        whose.extend((k, j, at + j) for j in range(len(t)))
        whose.append((k, len(t), -1))
        at += len(t)
    letters.append(0)
    whose.append((-1, 0, -1))
    out: list[list[tuple[int, int]]] = []
    last, run = b"", []
    for s in suffix_array(letters):
        k, j, a = whose[s]
        if k < 0 or j + length > len(texts[k]):
            continue
        this = joined[a : a + length]
        if this != last:
            if len(run) > 1:
                out.append(run)
            last, run = this, []
        run.append((k, j))
    if len(run) > 1:
        out.append(run)
    return out


def repeats_sorted(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """As ``repeats``, for many short texts: all their strings are sorted, without suffix pointers."""
    found: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for k, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            found[hashlib.blake2b(t[j : j + length], digest_size=16).digest()].append((k, j))
    return [v for v in found.values() if len(v) > 1]


# ---- anchors


def anchors(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The anchor occurrences of many texts: text, lo and hi (first and last string, in the text), a (the
    anchor, in the text), and the hashes of anchor and context."""
    n = len(buf)
    ends = offs[1:]
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return {"text": none, "lo": none, "hi": none, "a": none, "anchor": none, "context": none}
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[buf] * power[:n], out=sums[1:])
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    bits = np.uint64(max(20, int(n).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, span = LENGTH - ANCHOR + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    chosen = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # per string, where it starts
    text = np.repeat(np.arange(len(ends)), np.diff(offs))[: len(chosen)]
    valid = np.arange(len(chosen)) + LENGTH <= ends[text]
    starts = np.flatnonzero(valid)
    if len(starts) == 0:
        return {"text": none, "lo": none, "hi": none, "a": none, "anchor": none, "context": none}
    of, whose = chosen[starts], text[starts]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (whose[1:] != whose[:-1])]))
    lo, hi = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    a, whose = of[new], whose[new]
    context = mix((sums[hi + LENGTH] - sums[lo]) * inverse[lo] ^ mix(((a - lo) * 128 + (hi - lo)).astype(np.uint64)))
    base = offs[:-1][whose]
    return {"text": whose, "lo": lo - base, "hi": hi - base, "a": a - base, "anchor": grams[a].view(np.int64), "context": context.view(np.int64)}


#: kind 0: an occurrence (x = anchor, y = context); kind 1: bytes [x, y) to remove; kind 2: an open occurrence
#: (x and y are 0).  place packs lo (32 bits), a - lo and hi - lo (7 each).  m1 and m2 are the digest of the text
#: where an id is missing or repeats, and keep such rows apart; else they are 0.
_ROWS = "kind int, x long, y long, doc long, m1 long, m2 long, place long"
_KEY = ["doc", "m1", "m2"]
_FIRST = -(1 << 63)
#: Buckets of ids in which repeated ones are noted, and bits of the bitmap of documents that have rows.
_BUCKETS, _BITS = 1 << 16, 1 << 24


def _rows(kind: int, x: np.ndarray, y: np.ndarray, doc: np.ndarray, m1: np.ndarray, m2: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    cols = [np.full(len(x), kind, np.int32), x, y, doc, m1, m2, place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "x", "y", *_KEY, "place"])


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, a, hi."""
    lo = place >> 14
    return lo, lo + (place >> 7 & 127), lo + (place & 127)


def _spans(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 1 for the strings lo..hi of documents; those that touch are joined."""
    order = np.lexsort((lo, m2, m1, doc))
    lo, to, doc, m1, m2 = lo[order], hi[order] + LENGTH, doc[order], m1[order], m2[order]
    if len(lo):
        apart = np.concatenate([[True], (doc[1:] != doc[:-1]) | (m1[1:] != m1[:-1]) | (m2[1:] != m2[:-1]) | (lo[1:] > to[:-1])])
        at = np.flatnonzero(apart)
        lo, to, doc, m1, m2 = lo[at], np.maximum.reduceat(to, at), doc[at], m1[at], m2[at]
    return _rows(1, lo, to, doc, m1, m2, np.zeros(len(lo), np.int64))


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its key, at the very place of the first) of rows sorted by keys, document and place."""
    order = np.lexsort((lo, doc, *reversed(keys)))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    first = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    tie = (doc[order] == doc[order][head]) & (lo[order] == lo[order][head])
    return order, first, tie


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            anchor, context, doc, m1, m2, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = 0
            lo, _, hi = _unpack(place)
            order, first, tie = _later((anchor, context), doc, lo)
            # Rows that repeat an id and a text stand at one place: neither is later.  They go in the order of the texts, where
            # ids and places are alike and take little room in the shuffle.
            go = np.sort(order[first | tie])
            for k in range(0, len(go), 1 << 16):
                c = go[k : k + (1 << 16)]
                yield _rows(0, anchor[c], context[c], doc[c], m1[c], m2[c], place[c])
            done = order[~(first | tie)]
            yield _spans(lo[done], hi[done], doc[done], m1[done], m2[done])

    for b in slices(batches):
        buf, offs = bytes_of(b.column("text"))
        got = anchors(buf, offs)
        key = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[got["text"]] for c in _KEY)
        place = got["lo"] << 14 | got["a"] - got["lo"] << 7 | got["hi"] - got["lo"]
        held.append((got["anchor"], got["context"], *key, place))
        size += len(place)
        if size > HELD:
            yield from flush()
    yield from flush()


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = []
    for b in batches:
        kind, *cols = (b.column(c).to_numpy() for c in ("kind", "x", "y", *_KEY, "place"))
        yield _rows(1, *(c[kind == 1] for c in cols))
        parts.append(tuple(c[kind == 0] for c in cols))
    if not parts:
        return
    anchor, context, doc, m1, m2, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    lo, _, hi = _unpack(place)
    order, first, tie = _later((anchor, context), doc, lo)
    done = order[~(first | tie)]
    yield _spans(lo[done], hi[done], doc[done], m1[done], m2[done])
    heads = order[first]
    a = anchor[heads]
    same = a[1:] == a[:-1]
    several = np.unique(a[1:][same])
    stay = order[first | tie]
    opened = stay[np.isin(anchor[stay], several)]
    for k in range(0, len(opened), 1 << 16):
        c = opened[k : k + (1 << 16)]
        none = np.zeros(len(c), np.int64)
        yield _rows(2, none, none, doc[c], m1[c], m2[c], place[c])


_BLOCKS = "core long, doc long, m1 long, m2 long, start long, text binary"


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for text, doc, m1, m2, opened in zip(*(b.column(c) for c in ("text", *_KEY, "open")), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            key = doc.as_py(), m1.as_py(), m2.as_py()
            for place in opened.as_py():
                lo, a, hi = _unpack(place)
                for j in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
                    s0, s1 = max(lo, a - BLOCK * j - BLOCK + 1), min(hi, a - BLOCK * j)
                    core = raw[a - BLOCK * j : a - BLOCK * j + LENGTH - BLOCK + 1]
                    name = hashlib.blake2b(core + bytes([j]), digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), *key, s0, raw[s0 : s1 + LENGTH]))
        if out:
            cols = list(zip(*out, strict=True))
            kinds = [*[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["core", *_KEY, "start", "text"])


def _by_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[int, dict[bytes, list[tuple[int, int, int, int]]]] = defaultdict(lambda: defaultdict(list))
    for b in batches:
        for core, doc, m1, m2, start, text in zip(*(b.column(c).to_pylist() for c in ("core", *_KEY, "start", "text")), strict=True):
            groups[core][text].append((doc, start, m1, m2))
    out: list[tuple[int, int, int, int, int]] = []  # first and last string, document, digest
    for texts in groups.values():
        if sum(map(len, texts.values())) < 2:
            continue
        names = list(texts)
        where = [sorted(texts[t]) for t in names]
        for t, w in zip(names, where, strict=True):  # whole blocks that repeat
            out.extend((s, s + len(t) - LENGTH, d, *m) for d, s, *m in w[1:] if (d, s) != w[0][:2])
        if len(names) > 1:
            found = repeats(names) if len(names) <= LARGE else repeats_sorted(names)
            for run in found:
                at = [(*where[k][0][:1], where[k][0][1] + j, k, j) for k, j in run]
                first = min(at)[:2]
                out.extend((s, s, d, *m) for d, s, k, j in at if (d, s) != first for at_d, at_s, *m in where[k] if (at_d, at_s) == where[k][0][:2])
    if out:
        yield _spans(*(np.array(c, np.int64) for c in zip(*out, strict=True)))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
            raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            cover = np.zeros(len(raw) + 1, np.int32)
            if spans.is_valid:
                got = spans.values
                np.add.at(cover, got.field("x").to_numpy(), 1)
                np.add.at(cover, got.field("y").to_numpy(), -1)
            gone = np.cumsum(cover)[:-1] > 0
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = raw[~gone].tobytes()
            rows.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (doc, text) with m1, m2: both halves of the text's MD5 where the id is not the only one of its
    kind, 0 elsewhere.  Which ids repeat is noted by bucket, so some others get a digest too."""
    bucket = F.xxhash64("doc").bitwiseAND(_BUCKETS - 1)
    again = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(bucket.alias("bucket")).distinct().collect()
    if not again:
        return rows.select("*", F.lit(0).cast("long").alias("m1"), F.lit(0).cast("long").alias("m2"))
    noted = rows.sparkSession.createDataFrame(again, "bucket long").withColumn("again", F.lit(True))
    half = [F.conv(F.substring(F.md5("text"), k, 16), 16, -10).cast("long") for k in (1, 17)]
    joined = rows.withColumn("bucket", bucket).join(F.broadcast(noted), "bucket", "left")
    return joined.select(*rows.columns, *(F.when(F.col("again"), h).otherwise(F.lit(0).cast("long")).alias(m) for h, m in zip(half, _KEY[1:], strict=True)))


def _having(rows: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose document may be in ``some``, rows whose document is not), by a bitmap of fixed size."""
    at = F.xxhash64(*_KEY).bitwiseAND(_BITS - 1)
    word, bit = F.shiftright(at, 6), at.bitwiseAND(63).cast("int")
    noted = some.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    met = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(noted), "word", "left")
    held = F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False))
    return met.where(held).select(*rows.columns), met.where(~held).select(*rows.columns)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain).

    A byte goes if a 100-byte string over it also starts earlier: in a document of a smaller id, or in the
    same one before.  Null text counts as empty.  A null id comes before all others; rows that repeat an id
    and a text have the same start, so neither is earlier, and both lose the same bytes.  An empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = _keyed(rows)
    found = rows.select(*_KEY, "text").mapInArrow(_occurrences, _ROWS)
    # Occurrences meet by anchor; intervals that are already known pass by wherever.
    dealt = found.repartition(F.when(F.col("kind") == 0, F.col("x")).otherwise(F.xxhash64("doc", "x")))
    settled = cut(dealt.mapInArrow(_by_anchor, _ROWS), "anchors")
    opened = settled.where("kind = 2").select(*_KEY, "place")
    some, _ = _having(rows, opened)
    blocks = some.join(opened.groupBy(*_KEY).agg(F.collect_list("place").alias("open")), _KEY).select(*_KEY, "text", "open").mapInArrow(_cut_blocks, _BLOCKS)
    sorted_out = cut(blocks.repartition("core").mapInArrow(_by_core, _ROWS), "cores")
    spans = settled.where("kind = 1").union(sorted_out).select(*_KEY, "x", "y")
    some, whole = _having(rows, spans)
    met = some.join(spans.groupBy(*_KEY).agg(F.collect_list(F.struct("x", "y")).alias("spans")), _KEY, "left").select("doc_id", "text", "spans")
    every = met.unionByName(whole.select("doc_id", "text"), allowMissingColumns=True)
    return every.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS k FROM d WHERE n >= 100)),
f AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc_id, k) AS r FROM w),
s AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM f WHERE r > 1),
g AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM s),
iv AS (SELECT doc_id, min(k) AS lo, max(k) + 100 AS hi FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM iv),
a AS (SELECT p.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || any_value(substr(h, 2 * mx + 1)) AS kept
  FROM p JOIN (SELECT doc_id, max(hi) AS mx FROM iv GROUP BY doc_id) USING (doc_id) JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
