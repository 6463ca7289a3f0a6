"""TR10: a graph encoder over residue graphs, with given or seeded weights.

A layer gathers, for each node, its neighbours' states with distance and sequence flag (two joins on the node's key; a
node has as many neighbours as fit into the radius), and one Arrow pass computes messages, their mean, the update, the
residual and the layer norm.  States, not coordinates, move on, so the result does not change under rigid motions.
Structures are pooled by mean and read out to unit vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _checkpoint
from .neighbours import mean_vector

Layer = tuple[np.ndarray, np.ndarray]
#: Added to a variance before it divides.
EPS = 1e-5


def weights(width: int, hidden: int = 32, embed: int = 16, layers: int = 2, seed: int = 0) -> dict[str, list[Layer]]:
    """Matrices (out, in) and biases, uniform within 1 / sqrt(in), in the order in which they are used."""
    rng = np.random.default_rng(seed)

    def linear(fan_in: int, out: int) -> Layer:
        bound = 1 / np.sqrt(fan_in)
        return rng.uniform(-bound, bound, (out, fan_in)), rng.uniform(-bound, bound, out)

    out = {"input": [linear(width, hidden)]}
    for k in range(layers):
        out[f"layer{k}"] = [linear(2 * hidden + 2, hidden), linear(hidden, hidden), linear(2 * hidden, hidden)]
    return out | {"readout": [linear(hidden, hidden), linear(hidden, embed)]}


def linear(x: np.ndarray, w: Layer) -> np.ndarray:
    return x @ w[0].T + w[1]


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _mapped(df: DataFrame, column: str, width: int, to: str, keys: list[str], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keys`` and ``to``: f of the vectors in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(list(f(_matrix(b.column(column), width))), pa.list_(pa.float64()))], [*keys, to])

    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    return df.select(*keys, column).mapInArrow(run, ", ".join([*kinds, f"{to} array<double>"]))


def _updated(rows: DataFrame, w: list[Layer], hidden: int) -> DataFrame:
    """sid, res_id, h after one layer.  rows: sid, res_id, h, near: array of (src, h, distance, flag), or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = _matrix(b.column("h"), hidden)
            near = b.column("near")
            counts = np.array([len(s) if s.is_valid else 0 for s in near])
            flat = near.flatten()
            mean = np.zeros_like(own)
            if len(flat):
                at = np.repeat(np.arange(len(own)), counts)
                edge = np.stack([flat.field("distance").to_numpy(zero_copy_only=False), flat.field("flag").to_numpy(zero_copy_only=False)], axis=1)
                message = linear(silu(linear(np.concatenate([own[at], _matrix(flat.field("h"), hidden), edge], axis=1), w[0])), w[1])
                np.add.at(mean, at, message)
                mean /= np.maximum(counts, 1)[:, None]
            x = silu(linear(np.concatenate([own, mean], axis=1), w[2])) + own
            x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + EPS)
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("res_id"), pa.array(list(x), pa.list_(pa.float64()))], ["sid", "res_id", "h"])

    return rows.mapInArrow(run, "sid long, res_id int, h array<double>")


def encode(nodes: DataFrame, edges: DataFrame, w: dict[str, list[Layer]]) -> DataFrame:
    """sid, embedding (of length 1).  nodes: sid, res_id, features, all of the width of the input weights; edges: as
    ``spatial.radius_graph`` gives them.  A node without neighbours gets messages of mean 0."""
    hidden, width = w["input"][0][0].shape
    h = _mapped(nodes.select(F.col("sid").cast("long").alias("sid"), F.col("res_id").cast("int").alias("res_id"), "features"), "features", width, "h", ["sid", "res_id"], lambda x: linear(x, w["input"][0]))
    links = _checkpoint(edges.select(F.col("sid").cast("long").alias("sid"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("res_id"), F.col("distance").cast("double").alias("distance"), F.col("is_adjacent").cast("double").alias("flag")))
    for k in range(sum(name.startswith("layer") for name in w)):
        h = _checkpoint(h)
        from_ = links.join(h.select("sid", F.col("res_id").alias("src"), "h"), ["sid", "src"])
        near = from_.groupBy("sid", "res_id").agg(F.array_sort(F.collect_list(F.struct("src", "h", "distance", "flag"))).alias("near"))
        h = _updated(h.join(near, ["sid", "res_id"], "left"), w[f"layer{k}"], hidden)
    pooled = mean_vector(h.select("sid", F.col("h").alias("v")), "sid")

    def read(x: np.ndarray) -> np.ndarray:
        out = linear(silu(linear(x, w["readout"][0])), w["readout"][1])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return _mapped(pooled, "v", hidden, "embedding", ["sid"], read)
