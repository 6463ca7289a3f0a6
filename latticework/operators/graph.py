"""Similarity graphs: components, splits without leakage, and their audits.

Pairs: a, b and scores.  Components are found by contracting the graph; each round is written to the checkpoint folder,
so lost executors cost one round at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import before


def _checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the checkpoint folder.  A table knows its bytes.  ``checkpoint()`` keeps estimates of
    the plan instead, and a join's is the product of both sides': over some rounds a number of millions of digits."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="latticework-graph-")
    path = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """GR3: id, component (the smallest id reachable).  ids: id; edges: a, b.  Edges with an unknown end are
    ignored, ids without edges are alone.

    A round sends each node to whichever of itself and its neighbours has the least hash, a new hash every round, and
    joins the edges to what is left: a share of the nodes goes in each, however long a chain is, so rounds grow with the
    logarithm of the nodes and all of them together handle some times the first one's rows.  A name that has no more
    edges is a component; on the way back every round's nodes take the component of the name they went to."""
    known = _checkpoint(ids.select("id").distinct())
    end = lambda c: known.select(F.col("id").alias(c)).hint("merge")
    e = _checkpoint(edges.select("a", "b").where("a <> b").join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[tuple[DataFrame, DataFrame]] = []
    low = None
    while not e.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("v"))  # noqa: E731,B023
        near = e.union(e.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("near"))
        to = _checkpoint(near.select("a", F.least(rank("a"), "near")["v"].alias("to")))
        own = to.withColumn("low", F.col("a")) if low is None else to.join(low.select(F.col("to").alias("a"), "low").hint("merge"), "a")
        low = _checkpoint(own.groupBy("to").agg(F.min("low").alias("low")))
        rounds.append((to, low))
        ends = (to.select(F.col("a").alias(c), F.col("to").alias(f"{c}t")).hint("merge") for c in "ab")
        e = _checkpoint(e.join(next(ends), "a").join(next(ends), "b").where("at <> bt").select(F.least("at", "bt").alias("a"), F.greatest("at", "bt").alias("b")).distinct())
    found = None
    for to, low in reversed(rounds):
        held = low.withColumnRenamed("low", "component")
        if found is not None:
            held = low.join(found.select(F.col("a").alias("to"), "component").hint("merge"), "to", "left").select("to", F.coalesce("component", "low").alias("component"))
        found = _checkpoint(to.join(held.hint("merge"), "to").select("a", "component"))
    if found is None:
        return known.select("id", F.col("id").alias("component"))
    return _checkpoint(known.join(found.withColumnRenamed("a", "id").hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def threshold_sweep(ids: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...], coverage: float) -> DataFrame:
    """GR4: threshold, n_components, largest.  One run for all thresholds: a node is (threshold, id)."""
    levels = F.array(*(F.lit(t) for t in thresholds))
    key = lambda c: F.concat_ws(":", F.col("t").cast("string"), F.lpad(F.col(c).cast("string"), 12, "0"))
    nodes = ids.select("id", F.explode(levels).alias("t")).select(key("id").alias("id"))
    edges = pairs.where(F.col("coverage") >= coverage).select("a", "b", "identity", F.explode(levels).alias("t")).where("identity >= t").select(key("a").alias("a"), key("b").alias("b"))
    c = components(nodes, edges).withColumn("threshold", F.split("component", ":")[0].cast("double")).groupBy("threshold", "component").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"))


def greedy_balance(blocks: DataFrame, panels: int) -> DataFrame:
    """GR8: component, panel.  blocks: component, family, size.

    Families by total size, components by size, each to the panel with the least load of its family, then the
    least load of all; the first panel wins ties.  One choice depends on all before it, so the components -
    a few numbers each - go through one ordered pass per run; it is the only step that does.
    """
    total = blocks.groupBy("family").agg(F.sum("size").alias("total"))
    ordered = blocks.join(total, "family").select("component", "family", "size", "total", F.lit(0).alias("run"))

    def place(pdf):
        pdf = pdf.sort_values(["total", "family", "size", "component"], ascending=[False, True, False, True])
        load = [0] * panels
        own: dict = {}
        out = []
        for fam, size in zip(pdf["family"], pdf["size"], strict=True):
            mine = own.setdefault(fam, [0] * panels)
            k = min(range(panels), key=lambda j: (mine[j], load[j], j))
            mine[k] += size
            load[k] += size
            out.append(k)
        return pdf.assign(panel=out)[["component", "panel"]]

    return ordered.groupBy("run").applyInPandas(place, f"component {dict(blocks.dtypes)['component']}, panel int")


def best_match(tests: DataFrame, trains: DataFrame, pairs: DataFrame, score: str, where: Column | None = None) -> DataFrame:
    """GR13: id, best, nearest: the best score against the train side in either direction; 0 is no match and
    equals go to the smaller train id."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *pairs.columns[2:]))
    if where is not None:
        both = both.where(where)
    hits = both.where(F.col(score) > 0).join(trains.select(F.col("id").alias("b")), "b", "left_semi").join(tests.select(F.col("id").alias("a")), "a", "left_semi")
    best = hits.groupBy("a").agg(F.max(score).alias("best"), F.min_by("b", F.struct(-F.col(score), "b")).alias("nearest"))
    return tests.select("id").join(best.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"), "nearest")


def stratified_folds(groups: DataFrame, k: int, seed: int) -> DataFrame:
    """GR19: cluster, fold: round robin inside each stratum in a hashed order; clusters are never split."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string")), 256)
    by = Window.partitionBy("stratum").orderBy(order, "cluster")
    return groups.withColumn("fold", (F.row_number().over(by) - 1) % k)


def carve_validation(sizes: DataFrame, fraction: float) -> DataFrame:
    """GR20: the components, smallest first, taken while the sum before is under fraction of the whole.
    sizes: component, n."""
    target = F.floor(F.lit(fraction) * sizes.agg(F.sum("n")).first()[0])
    return before(sizes, ["n", "component"], "before", "n").where(F.col("before") < target).drop("before")
