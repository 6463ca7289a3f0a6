"""TR11, TR12: training of a linear encoder under the triplet loss, and the choice of its best epoch.

The encoder is a matrix W; a triplet (anchor, positive, negative) costs w * max(0, margin + |W(a - p)| - |W(a - n)|), w
the lesser of the tier weights of anchor and positive.  Every third epoch triplets are mined anew in the space of the
present W (semi-hard, TR8).  An epoch is one Spark job: tasks add gradients and losses over their triplets, in Arrow
batches, and Spark adds the tasks'.  The driver holds W and makes the step, with a rate that falls along a cosine.

Each epoch's W, losses and norm are written below ``state`` before the next begins.  A run that was lost goes on behind
the last epoch it finds there, and ends as if it had not been: triplets depend on nothing but the W of the epoch in which
they were mined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neighbours as nn
from .graph import _checkpoint

#: Epochs between two minings, the margin, the first rate, and weights by tier.
REMINE, MARGIN, LEARNING, TIERS = 3, 0.2, 0.05, (1.0, 0.85, 0.6, 0.35)


def start(embed: int, width: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(embed, width)) / math.sqrt(width)


def project(vectors: DataFrame, w: np.ndarray) -> DataFrame:
    """``vectors`` with v in the space of W."""
    sent, names = w, vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(list(x @ sent.T), pa.list_(pa.float64())) if c == "v" else b.column(c) for c in names], names)

    return vectors.mapInArrow(run, vectors.schema)


def mine(vectors: DataFrame, margin: float = MARGIN) -> DataFrame:
    """TR8: a, p, n for each positive: its nearest other positive, and the nearest negative beyond that within the
    margin, else the nearest of all.  vectors: id, v, label."""
    v = vectors.select("id", "v", "label")
    own, other = v.where("label = 'positive'").drop("label"), v.where("label <> 'positive'").drop("label")
    pairs = nn.nearest(own, own, 1, leave_self=True).select("q", F.col("id").alias("p"), F.col("d").alias("ap"))
    any_ = nn.nearest(own, other, 1).select("q", F.col("id").alias("near"), F.col("d").alias("nd"))
    found = _checkpoint(pairs.join(any_, "q"))
    # Where the nearest of all is beyond, it is the nearest beyond: only the others are searched again.
    asked = _checkpoint(own.join(found.where("nd <= ap"), F.col("id") == F.col("q")).select("id", "v", "ap"))
    semi = nn.nearest(asked, other, 1, above="ap").select("q", F.col("id").alias("beyond"), F.col("d").alias("an"))
    j = found.join(semi, "q", "left")
    return j.select(F.col("q").alias("a"), "p", F.when(F.col("an") < F.col("ap") + margin, F.col("beyond")).otherwise(F.col("near")).alias("n"))


def _with_vectors(triplets: DataFrame, vectors: DataFrame) -> DataFrame:
    """va, vp, vn, w, held (whether the anchor is kept for validation)."""
    weight = F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    side = lambda c: vectors.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), weight.alias(f"w{c}"), F.col("held").alias(f"h{c}"))
    j = triplets.join(side("a"), "a").join(side("p"), "p").join(side("n"), "n")
    return j.select("va", "vp", "vn", F.least("wa", "wp").alias("w"), F.col("ha").alias("held"))


def sums(rows: DataFrame, w: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, float, float]:
    """(gradient of the mean training loss, training loss, validation loss) of W over all triplets."""
    sent, (embed, width) = w, w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(embed * width + 4)
        for b in batches:
            if not b.num_rows:
                continue
            a, p, n = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("va", "vp", "vn"))
            weight, held = b.column("w").to_numpy(), b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            u, s = a - p, a - n
            zu, zs = u @ sent.T, s @ sent.T
            du, ds = np.linalg.norm(zu, axis=1), np.linalg.norm(zs, axis=1)
            loss = np.maximum(0, margin + du - ds)
            live = (loss > 0) & ~held
            gu, gs = zu / np.maximum(du, 1e-12)[:, None], zs / np.maximum(ds, 1e-12)[:, None]
            total[: embed * width] += ((gu * (weight * live)[:, None]).T @ u - (gs * (weight * live)[:, None]).T @ s).ravel()
            for k, rows_ in enumerate((~held, held)):
                total[embed * width + 2 * k] += (weight * loss)[rows_].sum()
                total[embed * width + 2 * k + 1] += weight[rows_].sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    added = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(embed * width + 4)
    for r in added:
        total[r.k] = r.x
    train, n_train, val, n_val = total[embed * width :]
    return total[: embed * width].reshape(embed, width) / max(n_train, 1e-8), train / max(n_train, 1e-8), val / max(n_val, 1e-8)


_EPOCHS = "epoch int, embed int, w array<double>, train_loss double, val_loss double"


def epochs(spark: SparkSession, state: str) -> DataFrame:
    """epoch, embed, w, train_loss, val_loss: what a run has written.  The W of an epoch is that after its step; its
    losses are those before."""
    try:
        return spark.read.schema(_EPOCHS).parquet(f"{state}/*")
    except AnalysisException:  # no epoch yet
        return spark.createDataFrame([], _EPOCHS)


def train(vectors: DataFrame, state: str, n: int, embed: int = 16, seed: int = 0, rate: float = LEARNING) -> DataFrame:
    """Goes on with the run in ``state`` until it has ``n`` epochs; returns ``epochs``.
    vectors: id, v, label, tier (1 to 4), held (of the validation share)."""
    spark = vectors.sparkSession
    vectors = _checkpoint(vectors.where("v is not null"))
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    done = {r.epoch: np.array(r.w).reshape(r.embed, -1) for r in epochs(spark, state).collect()}  # a small matrix an epoch
    done[-1] = start(embed, width, seed)
    rows = None
    for k in range(max(done) + 1, n):
        if rows is None or k % REMINE == 0:
            mined_at = done[k - k % REMINE - 1]
            rows = _checkpoint(_with_vectors(mine(project(vectors.select("id", "v", "label"), mined_at)), vectors))
        gradient, train_loss, val_loss = sums(rows, done[k - 1])
        done[k] = done[k - 1] - rate / 2 * (1 + math.cos(math.pi * k / n)) * gradient
        spark.createDataFrame([(k, embed, done[k].ravel().tolist(), float(train_loss), float(val_loss))], _EPOCHS).coalesce(1).write.mode("overwrite").parquet(f"{state}/epoch={k:05d}")
    return epochs(spark, state)


def best(run: DataFrame) -> tuple[int, np.ndarray]:
    """TR12: the epoch before whose step the validation loss was least (the first of equals), and the W it began with;
    epoch 0 began with the start, which no file holds, so it is chosen only where there is no other."""
    r = run.where("epoch > 0").orderBy("val_loss", "epoch").first()
    if r is None:
        r = run.orderBy("epoch").first()
        return r.epoch, np.array(r.w).reshape(r.embed, -1)
    before = run.where(F.col("epoch") == r.epoch - 1).first()
    return r.epoch, np.array(before.w).reshape(before.embed, -1)
