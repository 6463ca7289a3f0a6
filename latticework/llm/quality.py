"""Operator 4: quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Their accuracies are estimated by
expectation-maximisation on the histogram of vote patterns (counted over all documents by Spark; its size
is bounded by the patterns, not by the documents).  Posterior labels of a bounded sample then train a hashed
linear scorer, whose weights - of fixed size - are broadcast and score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, cut, discard, slices, table, word_hashes

#: Hash buckets for words beside the 2^14 word shapes; documents in the training sample (those whose hashed
#: ids are least, among different documents with a vote); passes over it; step; L2 weight; rounds of EM.
WORD_BUCKETS, SAMPLE, EPOCHS, STEP, DECAY, ROUNDS = 1 << 14, 8_000, 12, 0.5, 1e-5, 50
#: Words of a window in which variety is measured, so that a text's length does not matter.
WINDOW = 400
LABELLERS = ("symbols", "repeats", "capitals", "variety", "shouting", "bars", "sentences", "plain")
GOOD, BAD, NONE = 1, 0, -1
_SHAPES = 1 << 14
_SIZE = _SHAPES + WORD_BUCKETS + 2

_KIND = np.full(256, 12, np.uint16)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 13
for _k, _c in enumerate(b".,!#$%&*|"):
    _KIND[_c] = 3 + _k
_KIND[[9, 10, 11, 12, 13, 32]] = 15


def _variety(words: np.ndarray) -> float:
    """Mean share of distinct words over consecutive windows of WINDOW words; the last one ends with the text."""
    size = min(WINDOW, len(words))
    starts = np.minimum(np.arange(0, len(words), size), len(words) - size)
    parts = np.sort(words[starts[:, None] + np.arange(size)], axis=1)
    return float(((parts[:, 1:] != parts[:, :-1]).sum(axis=1) + 1).mean() / size)


def measure(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(votes per text and labeller, feature buckets of all words, words' texts, words per text)."""
    n = len(offs) - 1
    words, first = word_hashes(buf, offs)
    count = np.diff(first)
    whose = np.repeat(np.arange(n), count)
    kinds = _KIND[buf]
    bit = np.where(kinds < 14, np.left_shift(np.uint16(1), kinds), 0).astype(np.uint16)
    if len(words):
        inside = kinds != 15
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        at = offs[:-1]
        at = at[at < len(buf)]
        start[at] = inside[at]
        begins = np.flatnonzero(start)
        shape = np.bitwise_or.reduceat(bit, begins) & (_SHAPES - 1)
        length = np.add.reduceat(inside.astype(np.int64), begins)
    else:
        shape, length = np.zeros(0, np.uint16), np.zeros(0, np.int64)
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (whose[1:] == whose[:-1])]) if len(words) else np.zeros(0, bool)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(whose, weights=x, minlength=n) / np.maximum(count, 1)

    upper = (shape >> 1 & 1 == 1) & (shape & 1 == 0) & (length > 2)
    odd = (shape >> 5 & 0b1111111) > 0
    symbol, bars, shout = per_text((shape >> 6 & 0b11111) > 0), per_text(shape >> 11 & 1), per_text(shape >> 5 & 1)
    repeats, capitals, stops, plain = per_text(again), per_text(upper), per_text((shape >> 3 & 1) > 0), per_text(~(upper | odd | again))
    variety = np.ones(n)
    for k in range(n):
        if count[k] >= 40:
            variety[k] = _variety(words[first[k] : first[k + 1]])
    votes = np.full((n, len(LABELLERS)), NONE, np.int8)
    for k, (x, most) in enumerate(((symbol, 0.2), (repeats, 0.2), (capitals, 0.3), (-variety, -0.2), (shout, 0.2), (bars, 0.2))):
        votes[:, k] = np.where((x > most) & (count >= 5), BAD, NONE)
    votes[:, 6] = np.where((stops > 0.02) & (stops < 0.5) & (plain > 0.8), GOOD, NONE)
    votes[:, 7] = np.where(plain > 0.9, GOOD, np.where((plain < 0.6) & (count >= 5), BAD, NONE))
    votes[count == 0] = NONE
    features = np.concatenate([shape.astype(np.int64), _SHAPES + (words >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, np.full(int(again.sum()), _SIZE - 2)])
    return votes, features, np.concatenate([whose, whose, whose[again]]), count


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> dict:
    """EM over vote patterns: the share of good documents and each labeller's vote probabilities by class."""
    if len(patterns) == 0:
        return {"prior": 0.5, "p": np.full((2, len(LABELLERS), 3), 1 / 3)}
    agree = (patterns == GOOD).sum(axis=1) - 2.0 * (patterns == BAD).sum(axis=1)
    post = 1 / (1 + np.exp(-agree))
    for _ in range(rounds):
        p = np.empty((2, patterns.shape[1], 3))
        for c, r in ((GOOD, post * weights), (BAD, (1 - post) * weights)):
            for v in (NONE, BAD, GOOD):
                p[c, :, v + 1] = ((patterns == v) * r[:, None]).sum(axis=0) + 0.5
            p[c] /= p[c].sum(axis=1, keepdims=True)
        prior = (post * weights).sum() / weights.sum()
        post = posterior(patterns, {"prior": prior, "p": p})
    return {"prior": float(prior), "p": p}


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """Probability of good for each row of votes."""
    at = (np.arange(votes.shape[1])[None, :], votes.astype(int) + 1)
    prior = min(max(model["prior"], 1e-6), 1 - 1e-6)
    odds = np.log(prior / (1 - prior)) + (np.log(model["p"][GOOD][at]) - np.log(model["p"][BAD][at])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic scorer (Adagrad, one document at a time) for (buckets, values, label) rows."""
    w, seen = np.zeros(_SIZE), np.full(_SIZE, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -50, 50))) - y) * x + DECAY * w[at]
            seen[at] += g * g
            w[at] -= STEP * g / np.sqrt(seen[at])
    return w


VOTES = "doc_id long, text_key long, votes binary"
#: The votes of a document on which nobody votes.
SILENT = np.full(len(LABELLERS), NONE, np.int8).tobytes()


def weak_votes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), votes (a byte per labeller: 0 bad, 1 good, 255 none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            votes = measure(*bytes_of(b.column("text")))[0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([v.tobytes() for v in votes], pa.binary())], ["doc_id", "text_key", "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, VOTES)


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, p_weak (the labellers' posterior), score (the scorer's, 0 to 1), good.

    A null or empty text has no words: nobody votes on it, and it scores 0.  Rows that repeat a doc_id
    each give a row, but rows with one id and one text are one document of the sample; equal hashes of ids are
    taken in the order of the ids.  Very long texts are measured whole.  An empty table gives no rows.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cast = cut(weak_votes(rows), "votes")
    found = cast.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("votes")
    width = len(LABELLERS)
    patterns = np.frombuffer(b"".join(found["votes"]), np.int8).reshape(-1, width) if len(found) else np.zeros((0, width), np.int8)
    model = estimate(patterns, found["n"].to_numpy(float))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            votes, buckets, whose, count = measure(*bytes_of(b.column("text")))
            post = posterior(votes, model)
            keep = []
            order = np.argsort(whose, kind="stable")
            ends = np.searchsorted(whose[order], np.arange(len(count) + 1))
            for k in range(len(count)):
                at, n = np.unique(buckets[order[ends[k] : ends[k + 1]]], return_counts=True)
                keep.append((np.append(at, _SIZE - 1).astype("<i4").tobytes(), np.append(n / max(1, count[k]), 1.0).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(post), pa.array([x[0] for x in keep], pa.binary()), pa.array([x[1] for x in keep], pa.binary())], ["doc_id", "text_key", "p", "at", "x"])

    # Different documents first: neither an id nor a text that many rows repeat fills the sample or the driver.
    chosen = cast.where(F.col("votes") != F.lit(SILENT)).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct().orderBy(F.xxhash64("id"), "id", "key").limit(sample)
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    picked = keyed.join(F.broadcast(chosen), keyed["doc_id"].eqNullSafe(chosen["id"]) & (keyed["text_key"] == chosen["key"]), "left_semi")
    once = picked.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    learned = once.mapInArrow(features, "doc_id long, text_key long, p double, at binary, x binary").toPandas().sort_values(["doc_id", "text_key"])
    discard(cast)
    weights = fit([(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float), float(p)) for a, x, p in zip(learned["at"], learned["x"], learned["p"], strict=True)])
    sent = spark.sparkContext.broadcast((model, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        for b in slices(batches):
            votes, buckets, whose, count = measure(*bytes_of(b.column("text")))
            total = np.bincount(whose, weights=w[buckets], minlength=len(count)) / np.maximum(count, 1) + w[-1]
            s = np.where(count > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(posterior(votes, known)), pa.array(s), pa.array(s >= threshold)], ["doc_id", "p_weak", "score", "good"])

    return rows.mapInArrow(score, "doc_id long, p_weak double, score double, good boolean")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
