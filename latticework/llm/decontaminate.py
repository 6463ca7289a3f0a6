"""Operator 7: benchmark decontamination.

The items' word windows, normalised, make one Aho-Corasick automaton, which scans every text once; hits are mapped back
to offsets in the original text.  An automaton holds BLOCK_BYTES of item text, which is also what is broadcast at a
time.  More items make more blocks (a longer item is cut where windows overlap, so no window is lost): each block but
the last goes over the texts in a pass of its own, which writes what it found by the digest of the text, and the last
pass unites it all.  A task builds its automaton once and takes the texts in slices of about a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, table

#: Words in a window, and the most bytes of item text in one automaton.
WINDOW, BLOCK_BYTES = 10, 4 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
#: A-Z become a-z, bytes outside words become blanks (all bytes of a character beyond ASCII are inside).
_FOLD = bytes(c + 32 if 65 <= c < 91 else c if _INSIDE[c] else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Runs of ``size`` words, or the whole of a shorter text, with a blank at either end."""
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))] if words else []


def automaton(items: list[tuple[str, str]], size: int = WINDOW) -> ahocorasick.Automaton:
    """Each window's value: (its length, the items that hold it)."""
    held: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(words_of(text), size):
            held.setdefault(w, set()).add(item)
    out = ahocorasick.Automaton()
    for w, ids in held.items():
        out.add_word(w.decode("latin-1"), (len(w), tuple(sorted(ids))))
    if held:
        out.make_automaton()
    return out


def scan(found: ahocorasick.Automaton, text: str | None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, the numbers of those inside a window, and the items that occur."""
    words = words_of(text)
    items: set[str] = set()
    if not words or not len(found):
        return len(words), np.zeros(0, np.int64), items
    line = b" " + b" ".join(words) + b" "
    hits = [(end, length, ids) for end, (length, ids) in found.iter(line.decode("latin-1"))]
    if not hits:
        return len(words), np.zeros(0, np.int64), items
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.array([h[0] for h in hits])
    first, last = np.searchsorted(blanks, ends - np.array([h[1] for h in hits]) + 1), np.searchsorted(blanks, ends)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    for h in hits:
        items.update(h[2])
    return len(words), np.flatnonzero(np.cumsum(cover)[:-1] > 0), items


def offsets(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets [begin, end) in the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    word = _INSIDE[raw]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(hit) > 1)
    heads, tails = hit[np.concatenate([[0], breaks + 1])], hit[np.concatenate([breaks, [len(hit) - 1]])]
    return [{"begin": int(lead[starts[a]]), "end": int(lead[ends[b]])} for a, b in zip(heads, tails, strict=True)]


def pieces(text: str, size: int, limit: int) -> Iterator[str]:
    """A text in parts of about ``limit`` bytes that hold the same windows."""
    if len(text.encode("utf-8", "surrogatepass")) <= limit:
        yield text
        return
    words = words_of(text)
    start = end = 0
    while end < len(words):
        end, held = min(len(words), start + size), 0
        while end < len(words) and held + len(words[end]) < limit:
            held += len(words[end]) + 1
            end += 1
        yield b" ".join(words[start:end]).decode("utf-8", "surrogatepass")
        start = end - size + 1


def blocks_of(benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``limit`` bytes each, in the order of their ids; one block is on the driver at a
    time.  The last block may be empty."""
    block: list[tuple[str, str]] = []
    held = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        for piece in pieces(text, size, limit):
            n = len(piece.encode("utf-8", "surrogatepass"))
            if held and held + n > limit:
                yield block
                block, held = [], 0
            block.append((item, piece))
            held += n
    yield block


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin:long,end:long>>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]


def _found(texts: DataFrame, block: list[tuple[str, str]], size: int) -> DataFrame:
    """key, hit (numbers of words), names (of items) of the texts in which a block's windows occur."""
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sent.value, size)
        for part in slices(batches):
            keys, hits, names = [], [], []
            for key, text in zip(part.column("key").to_pylist(), part.column("text"), strict=True):
                _, hit, items = scan(found, text.as_py())
                if items:
                    keys.append(key)
                    hits.append(hit.tolist())
                    names.append(sorted(items))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["key", "hit", "names"])

    return cut(texts.mapInArrow(run, "key string, hit array<long>, names array<string>").dropDuplicates(["key"]), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans; with
    ``carry``, all columns of the input come along in a struct ``row`` instead of the id.

    ``spans`` are character offsets in the original text.  A null or empty text, and one without words,
    has no hits; items that are null or have no words occur nowhere; item ids are compared as strings.
    Repeated rows each give a row; an empty benchmark finds nothing; an empty table gives no rows.  Very long texts are
    scanned whole, each as a slice of its own; very long items are cut into parts with the same windows.
    """
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.col("doc_id").cast("long")
    given = docs.select(carried.alias("row"), "text")
    earlier: list[DataFrame] = []
    last: list[tuple[str, str]] | None = None
    for block in blocks_of(benchmark, size, limit):
        if last is not None:
            earlier.append(_found(docs.where("text is not null").select(F.md5("text").alias("key"), "text"), last, size))
        last = block
    if earlier:
        hits = reduce(DataFrame.union, earlier).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
        given = given.withColumn("key", F.md5("text")).join(hits, "key", "left").select("row", "text", "hit", "names")
    sent, united = docs.sparkSession.sparkContext.broadcast(last), bool(earlier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sent.value, size)
        for part in slices(batches):
            more = [part.column(c) for c in ("hit", "names")] if united else None
            rows = []
            for k, scalar in enumerate(part.column("text")):
                text = scalar.as_py()
                n, hit, items = scan(found, text)
                if more is not None and more[0][k].is_valid:
                    hit, items = np.union1d(hit, np.array(more[0][k].as_py(), np.int64)), items | set(more[1][k].as_py())
                names = sorted(items)
                rows.append((n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0, names, offsets(text, hit) if len(hit) else []))
            names = ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True))], names)

    return given.mapInArrow(run, T.StructType([given.schema["row"], *T.StructType.fromDDL(SCHEMA)])).withColumnRenamed("row", "row" if carry else "doc_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item, dw.n, k FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
