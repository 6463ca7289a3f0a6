"""Operator 6: byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts it where the content says so, so equal passages of different
documents yield equal chunks wherever they stand.  Each different chunk is encoded once in a worker (within
a bounded memory of chunks) and its ids are reused.  A cut may fall inside a word, so each join is repaired:
text between the last safe place before the cut and the first one after it is encoded again, and the window
grows to the next chunk until the reused ids break exactly at those places.

A *safe place* is a blank between two printable ASCII bytes.  The vocabulary's splitting pattern always ends
a piece there, whatever stands around it, so ids on both sides are those of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bytes_of, mix, slices, table

#: log2 of the mean chunk length in bytes, bytes that the rolling hash sees, bytes of chunks remembered.
CHUNK_BITS, SEEN_BYTES, CACHE_BYTES = 9, 16, 24 << 20

#: Characters of white space in a row that go to the tokenizers library.
LONG_BLANK = 5000
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")

_GEAR = mix(np.arange(256, dtype=np.uint64) + np.uint64(12345)).astype(np.uint32)


class Codec:
    """A byte-level BPE vocabulary, with the chunks that this worker has encoded."""

    def __init__(self, path: str, chunk_bits: int = CHUNK_BITS, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        self.path = path
        whole = _library(path)
        plain = _plain_bytes()
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        vocab = whole.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.raw = np.full(size, b"", object)
        for token, i in vocab.items():
            self.raw[i] = token.encode() if token in self.special else bytes(plain[c] for c in token)
        self.length = np.array([len(x) for x in self.raw], np.int64)
        self.decimal = np.array([str(i) for i in range(size)], object)
        ranks = {self.raw[i]: i for t, i in vocab.items() if t not in self.special}
        # The same merges in a quicker library.
        self.fast = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.mask = np.uint32((1 << chunk_bits) - 1)
        self.cache_bytes, self.held = cache_bytes, 0
        self.chunks: dict[bytes, np.ndarray] = {}

    def encode_piece(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "surrogatepass")
        if len(text) > LONG_BLANK and _LONG_BLANK.search(text):  # on which the quicker library's pattern engine gives up
            return np.array(_library(self.path).encode(text, add_special_tokens=False).ids, np.uint32)
        if any(s in text for s in self.special):
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def chunk(self, raw: bytes) -> np.ndarray:
        ids = self.chunks.get(raw)
        if ids is None:
            if self.held > self.cache_bytes:
                self.chunks.clear()
                self.held = 0
            ids = self.chunks[raw] = self.encode_piece(raw)
            self.held += len(raw) + ids.nbytes + 200  # with the objects about them
        return ids

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Places where the hash of the bytes before says so, moved on to the next character's start."""
        h = _GEAR[buf]
        step = 1
        while step < SEEN_BYTES:
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        at = np.flatnonzero((h >> np.uint32(15) & self.mask) == 0) + 1
        tail = np.concatenate([(buf & 0xC0) == 0x80, [False, False, False, False]])
        for _ in range(3):
            at = at + tail[at]
        return np.unique(at)

    def encode_all(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each of many texts that lie one after the other in ``buf``."""
        if len(buf) == 0:
            return [np.zeros(0, np.uint32)] * (len(offs) - 1)
        cuts = self.cuts(buf)
        shown = (buf > 32) & (buf < 127)
        safe = np.flatnonzero((buf[1:-1] == 32) & shown[:-2] & shown[2:]) + 1
        data = buf.tobytes()
        cut_from, safe_from = np.searchsorted(cuts, offs, side="right"), np.searchsorted(safe, offs)
        out = []
        for k in range(len(offs) - 1):
            lo, hi = int(offs[k]), int(offs[k + 1])
            inner = cuts[cut_from[k] : np.searchsorted(cuts, hi)]
            out.append(self._encode(data, lo, hi, inner.tolist(), safe[safe_from[k] : safe_from[k + 1]]))
        return out

    def _encode(self, data: bytes, lo: int, hi: int, inner: list[int], safe: np.ndarray) -> np.ndarray:
        if lo == hi:
            return np.zeros(0, np.uint32)
        edges = [lo, *inner, hi]
        after = np.searchsorted(safe, edges)  # first safe place at or after each edge
        upto = np.searchsorted(safe, edges, side="right") - 1  # last at or before it
        out: list[np.ndarray] = []
        done = lo  # all before is in ``out``
        for j in range(len(edges) - 1):
            a, b = edges[j], edges[j + 1]
            first = a if a == lo else int(safe[after[j]]) if after[j] < len(safe) else hi
            last = b if b == hi else int(safe[upto[j + 1]]) if upto[j + 1] >= 0 else lo
            if not a <= first < last <= b:
                continue  # no safe place in this chunk: the repair of the joins covers it
            ids = self.chunk(data[a:b])
            ends = np.cumsum(self.length[ids])
            i = int(np.searchsorted(ends, first - a, side="right")) if first > a else 0
            n = int(np.searchsorted(ends, last - a, side="right"))
            if (i and ends[i - 1] != first - a) or (first > a and not i) or not n or ends[n - 1] != last - a:
                continue  # no agreement here: the window grows over this chunk
            if done < first:
                out.append(self.encode_piece(data[done:first]))
            out.append(ids[i:n])
            done = last
        if done < hi:
            out.append(self.encode_piece(data[done:hi]))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.raw[ids].tolist()).decode("utf-8", "replace")


def _library(path: str):
    """The vocabulary in the tokenizers library, which a worker needs for a moment only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _plain_bytes() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(b: pa.RecordBatch, c: Codec) -> list[np.ndarray]:
    return c.encode_all(*bytes_of(b.column("text")))


def _decoded(doc_ids: pa.Array, every: list[np.ndarray], c: Codec, with_text: bool) -> pa.RecordBatch:
    rows = []
    for ids in every:
        text = c.decode(ids)
        rows.append((len(ids), hashlib.sha256(",".join(c.decimal[ids].tolist()).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text if with_text else None))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text"]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True))][: 4 + with_text], names[: 4 + with_text])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit): whole texts as the tokenizers library encodes them with
    ``path`` and no added special tokens.

    Null counts as empty and has no ids; each row gives one row, repeated ones and those without an id too.
    Very long texts are taken one at a time.  An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, limit=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in _encoded(b, c)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, text: from the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "ids", 4 * SLICE_BYTES):
            yield _decoded(b.column("doc_id"), [np.frombuffer(raw.as_buffer(), "<u4") for raw in b.column("ids")], c, True)

    return encoded.mapInArrow(run, f"{SCHEMA}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task needs one worker with one vocabulary: doc_id, n_tokens,
    ids_sha256, decoded_sha256 (the text from the ids alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, limit=SLICE_BYTES):
            yield _decoded(b.column("doc_id"), _encoded(b, c), c, False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
