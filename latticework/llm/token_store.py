"""Operator 5: token ids in patched frame-of-reference files.

Documents are dealt by ranges of doc_id, so the shards, in order, hold ascending ids.  Each task encodes
its documents and writes shards to the shared folder; a manifest (one row per shard) is written by the
same job, and only shards that it names are read: what a lost or repeated task attempt left is ignored.

File format (little-endian):

    magic "LWPFOR01"
    blocks            header <IBBHI> = minimum, width, 0, exceptions, values; packed low bits;
                      exception places (uint16), exception high parts (uint32)
    block starts      uint64 each
    documents         int64 id, uint8 has_id, uint64 first token in the file, uint64 tokens
    trailer           <QQIQQ> = offset of the block starts, blocks, values in a block, documents, tokens

A block's minimum is subtracted, values are packed at the width that holds the given percentile of them,
and the rest keep their high bits in the exception list.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, shared_dir, slices, table

#: Values in a block (32 lanes of 32), share of values that the width must hold, tokens after which a shard
#: is closed, and words that a worker remembers.
BLOCK, PERCENTILE, SHARD_TOKENS, CACHE_WORDS = 1024, 0.9, 2_000_000, 1_000_000
MAGIC, TRAILER, HEAD = b"LWPFOR01", struct.Struct("<QQIQQ"), struct.Struct("<IBBHI")
DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("n", "<u8")])


# ---- the block code


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1,024 numbers below 2^width as rows of 32 x width words: lane k has the numbers k, k+32, ..."""
    lanes = values.reshape(-1, 32, 32).astype(np.uint64)
    out = np.zeros((len(lanes), width + 2, 32), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        moved = lanes[:, i, :] << np.uint64(shift)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return out[:, :width].astype("<u4")


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The opposite of ``pack``; words: (blocks, width, 32)."""
    wide = np.zeros((len(words), width + 2, 32), np.uint64)
    wide[:, :width] = words
    out = np.empty((len(words), 32, 32), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, i, :] = (wide[:, word] | wide[:, word + 1] << np.uint64(32)) >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out.reshape(len(words), 1024).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Each block of up to 1,024 ids as bytes; blocks of one width are packed together."""
    n = -(-len(ids) // BLOCK)
    counts = np.full(n, BLOCK)
    if n:
        counts[-1] = len(ids) - BLOCK * (n - 1)
    full = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).reshape(n, BLOCK).astype(np.uint32)
    low = full.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    bits = np.ceil(np.log2(np.sort(rest, axis=1)[:, int(percentile * BLOCK) - 1].astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * n
    for width in np.unique(bits):
        at = np.flatnonzero(bits == width)
        mask = np.uint32((1 << int(width)) - 1) if width < 32 else np.uint32(0xFFFFFFFF)
        packed = pack(rest[at] & mask, int(width))
        for j, k in enumerate(at):
            odd = np.flatnonzero(rest[k, : counts[k]] > mask)
            high = (rest[k, odd].astype(np.uint64) >> np.uint64(width)).astype("<u4")
            out[k] = HEAD.pack(int(low[k]), int(width), 0, len(odd), int(counts[k])) + packed[j].tobytes() + odd.astype("<u2").tobytes() + high.tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    heads = [HEAD.unpack_from(data, int(s)) for s in starts]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads], int)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        words = np.stack([np.frombuffer(data, "<u4", int(width) * 32, int(starts[k]) + HEAD.size).reshape(int(width), 32) for k in at])
        out[at] = unpack(words, int(width))
    for k, (low, width, _, odd, _) in enumerate(heads):
        if odd:
            at = int(starts[k]) + HEAD.size + 128 * width
            where, high = np.frombuffer(data, "<u2", odd, at), np.frombuffer(data, "<u4", odd, at + 2 * odd)
            out[k, where] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
        out[k] += np.uint32(low)
    return np.concatenate([out[k, : h[4]] for k, h in enumerate(heads)]) if heads else np.zeros(0, np.uint32)


def shard_bytes(doc_ids: list[int | None], parts: list[np.ndarray], percentile: float = PERCENTILE) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    blocks = encode_blocks(ids, percentile)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1].astype("<u8") + len(MAGIC) if blocks else np.zeros(0, "<u8")
    docs = np.zeros(len(doc_ids), DOC)
    docs["doc_id"], docs["has_id"], docs["n"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids], [len(p) for p in parts]
    docs["start"] = np.cumsum(docs["n"]) - docs["n"]
    body = MAGIC + b"".join(blocks)
    return body + starts.astype("<u8").tobytes() + docs.tobytes() + TRAILER.pack(len(body), len(blocks), BLOCK, len(docs), len(ids))


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document table, all ids) of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at, blocks, size, docs, tokens = TRAILER.unpack_from(data, len(data) - TRAILER.size)
    if size != BLOCK:
        raise ValueError(f"blocks of {size} values")
    ids = decode_blocks(data, np.frombuffer(data, "<u8", blocks, at))
    if len(ids) != tokens:
        raise ValueError("the file's token count is not met")
    return np.frombuffer(data, DOC, docs, at + 8 * blocks), ids


def read_range(data: bytes, start: int, n: int) -> np.ndarray:
    """Ids [start, start + n) of a file; only the blocks that hold them are decoded."""
    at, blocks, size, _, _ = TRAILER.unpack_from(data, len(data) - TRAILER.size)
    starts = np.frombuffer(data, "<u8", blocks, at)[start // size : -(-(start + n) // size)]
    return decode_blocks(data, starts)[start % size : start % size + n]


# ---- the encoder


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    vocab = out.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return out, ends, {}


_STOP, _OTHER = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])([.,]) "), re.compile("[^a-z\u00df-\u00f6\u00f8-\u00ff][.,] ")


def _pieces(text: str | None) -> list[str]:
    """The text, cut where the pre-tokenizer surely cuts it: at blanks and line ends, and before one full
    stop or comma between a letter and a blank.  Case is folded, as the normaliser does, where that cannot
    depend on context or make a special token."""
    if not text:
        return []
    if not ("<|" in text or "\u03a3" in text or "\u0130" in text):
        text = text.lower()
    text = text.replace("\n", " ")
    if _OTHER.search(text):
        text = _STOP.sub(r" \1 ", text)
    else:
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts.  The vocabulary's pre-tokenizer drops white space and looks at nothing beyond it,
    so a text's ids are those of its pieces; each different piece goes to the tokenizer once in a worker, as
    long as it is remembered.  New pieces of letters only, one word each, go as one line: word ends part it."""
    tokenizer, ends, seen = _tokenizer(path)
    if len(seen) > CACHE_WORDS:
        seen.clear()
    split = [_pieces(t) for t in texts]
    every = [w for words in split for w in words]
    got = list(map(seen.get, every))
    new = {w for w, x in zip(every, got, strict=True) if x is None}
    if new:
        plain = [w for w in new if w.isalpha()]
        lines = [plain[k : k + 2000] for k in range(0, len(plain), 2000)]
        for words, e in zip(lines, tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            to = (np.flatnonzero(ends[ids]) + 1) * 4
            if len(to) == len(words) and (len(to) == 0 or to[-1] == 4 * len(ids)):
                raw, to = ids.tobytes(), to.tolist()
                seen.update(zip(words, [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)], strict=True))
        rest = [w for w in new if w not in seen]
        for w, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            seen[w] = np.array(e.ids, "<u4").tobytes()
        for k in [k for k, x in enumerate(got) if x is None]:
            got[k] = seen[every[k]]
    out, at = [], 0
    for words in split:
        out.append(np.frombuffer(b"".join(got[at : at + len(words)]), "<u4"))
        at += len(words)
    return out


# ---- the operator


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, percentile: float = PERCENTILE) -> DataFrame:
    """Encode documents and write them in ascending doc_id order below ``folder`` (a URI that tasks can
    write); returns the manifest (part, seq, name, n_docs, n_tokens), written as well.

    Null text counts as empty: such a document is its end id alone.  A null id sorts first and is kept as
    null; rows that repeat an id follow each other.  An empty table writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = seq = 0
        end = np.array([end_id], "<u4")

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, parts, held, seq
            name = f"tokens-{part:06d}-{seq:05d}-{attempt}.pfor"
            with fs.open_output_stream(f"{top}/.{name}", compression=None) as f:
                f.write(shard_bytes(doc_ids, parts, percentile))
            fs.move(f"{top}/.{name}", f"{top}/{name}")
            row = [part, seq, name, len(doc_ids), held]
            doc_ids, parts, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(dict(zip(["part", "seq", "name", "n_docs", "n_tokens"], [[x] for x in row], strict=True)))

        for b in slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode_texts(b.column("text").to_pylist(), tokenizer_path), strict=True):
                doc_ids.append(doc)
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return cut(dealt.mapInArrow(write, "part long, seq long, name string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The files' documents: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit).  A shard of the
    manifest that is not there is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                docs, ids = read_shard(data.as_py())
                raw = ids.astype("<u4").tobytes()
                cuts = [raw[4 * int(d["start"]) : 4 * int(d["start"] + d["n"])] for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.as_py().rsplit("/", 1)[-1]] * len(docs), pa.string()),
                        pa.array([int(d["doc_id"]) if d["has_id"] else None for d in docs], pa.int64()),
                        pa.array(docs["start"].astype(np.int64)),
                        pa.array(docs["n"].astype(np.int64)),
                        pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                        pa.array(cuts, pa.binary()),
                    ],
                    ["name", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    before = manifest.select("name", (F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens")).alias("before"))
    schema = "name string, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema).select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32", "ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.pfor").load(folder).select("path", "content")
    found = before.join(files.mapInArrow(read, schema), "name", "left")
    lost = F.raise_error(F.concat(F.lit("a shard of the manifest is missing: "), "name")).cast("long")
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.coalesce("n_tokens", lost).alias("n_tokens"), "ids_crc32", "ids")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder, manifest).drop("ids")
