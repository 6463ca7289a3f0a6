"""Operator 8: language identification.

Multinomial naive Bayes over hashed character n-grams.  One distributed pass counts n-grams per
language (each task sends at most one row per language and bucket), the log-probability matrix - fixed
size: buckets x languages - is broadcast, and whole texts are scored in numpy, a slice of rows at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Parameters: hash buckets, n-gram lengths, additive smoothing, most languages a model may have.
BUCKETS, ORDERS, SMOOTHING, MAX_LANGS = 1 << 15, (1, 2, 3), 0.05, 4096
#: Places times languages whose log-probabilities are held at once.
GATHER = 1 << 20
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str | None], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, blanks for what is no letter, each text followed by so many blanks
    that no n-gram from one of its letters reaches into the next text."""
    end = " " * max(1, *(order - 1 for order in orders))
    low = [(t or "").lower() + end for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[codes], codes, np.uint32(32)).astype(np.uint64), offs


def _grams(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram at each place; ``buckets`` where it begins with a blank."""
    h = np.full(len(codes), order, np.uint64)
    for k in range(order):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h[: len(codes) - k] += codes[k:] * np.uint64(0xC2B2AE3D27D4EB4F)
    out = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets
    out[codes == 32] = buckets
    return out


def _add(total: np.ndarray, log_p: np.ndarray, grams: np.ndarray, offs: np.ndarray) -> None:
    """Adds each text's log-probabilities to its row, some places at a time; texts may go over several of them."""
    step = max(1, GATHER // log_p.shape[1])
    for lo in range(0, len(grams), step):
        hi = min(len(grams), lo + step)
        first, last = np.searchsorted(offs, lo, side="right") - 1, np.searchsorted(offs, hi, side="left")
        total[first:last] += np.add.reduceat(log_p[grams[lo:hi]], np.maximum(offs[first:last] - lo, 0), axis=0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> dict:
    """Counts over all given rows with a language; {"langs", "log_p" (buckets + 1, langs), "log_prior"}."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            texts, of = b.column("text").to_pylist(), b.column("lang").to_pylist()
            codes, offs = _codes(texts, orders)
            names = sorted(set(of))
            which = np.repeat(np.array([names.index(x) for x in of], np.int64), np.diff(offs))
            for name in names:
                got = sums.setdefault(name, np.zeros(buckets + 2, np.int64))
                got[buckets + 1] += of.count(name)
            for order in orders:
                c = np.bincount(which * (buckets + 1) + _grams(codes, order, buckets), minlength=len(names) * (buckets + 1))
                for k, name in enumerate(names):
                    sums[name][:buckets] += c[k * (buckets + 1) : k * (buckets + 1) + buckets]
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    found = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the matrix that is broadcast is made for {MAX_LANGS} at most")
    counts = np.zeros((buckets + 2, len(langs)))
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)] = found["n"].to_numpy()
    grams = counts[:buckets] + SMOOTHING
    log_p = np.vstack([np.log(grams / grams.sum(axis=0)), np.zeros((1, len(langs)))])
    return {"langs": langs, "log_p": log_p, "log_prior": np.log(counts[buckets + 1] / max(1, counts[buckets + 1].sum())), "orders": orders}


def predict(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (posterior probability of lang_pred); with ``carry``, all columns of the input
    come along in a struct ``row`` instead of the id, which spares a filter the join back.

    A text that is null or has no letter gets ``und`` and score 0, as has every text where no language
    was learned.  Equal posteriors go to the language that sorts first.  Other columns are not read.
    """
    langs, orders = model["langs"], model["orders"]
    sent = docs.sparkSession.sparkContext.broadcast((model["log_p"], model["log_prior"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, prior = sent.value
        buckets = len(log_p) - 1
        for b in slices(batches):
            codes, offs = _codes(b.column("text").to_pylist(), orders)
            has = np.add.reduceat(codes != 32, offs[:-1]) > 0
            if langs:
                total = np.tile(prior, (len(offs) - 1, 1))
                for order in orders:
                    _add(total, log_p, _grams(codes, order, buckets), offs)
                total = np.exp(total - total.max(axis=1, keepdims=True))
                total /= total.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                names = [langs[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                p = np.where(has, total[np.arange(len(best)), best], 0.0)
            else:
                names, p = [UNKNOWN] * len(has), np.zeros(len(has))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(p, pa.float64())], ["row", "lang_pred", "score"])

    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.col(doc_id).cast("long")
    rows = docs.select(carried.alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(score, T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang_pred string, score double")])).withColumnRenamed("row", "row" if carry else "doc_id")


def held_out(doc_id: str = "doc_id"):
    """The fold: a checksum of the id, 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
