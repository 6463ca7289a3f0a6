"""Stand-in views: the engine's concepts (atoms, sites, pairs, panels) on the given tables.

Each view has its SQL twin for the checks, so that an operator's SQL can begin ``WITH atom AS (...)``.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines whose pairs one task makes, and pairs that one task groups.
LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, idx, res_id, role, res_name, atom_name, element, chain_id, b_factor, x, y, z: 21 atoms a vector.  Spark's
    estimate is that of the vectors, so joins of atoms are told not to broadcast them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sid"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("idx"))
    role = F.when(F.col("idx") % 5 == 0, "ASP_O").when(F.col("idx") % 5 == 1, "CYS_S").otherwise("HIS_N")
    at = [F.element_at("embedding", F.col("idx") * 3 + k).cast("double") * 20 for k in (1, 2, 3)]
    res = F.when(role == "ASP_O", "ASP").when(role == "CYS_S", "CYS").otherwise("HIS")
    atom = F.when(role == "ASP_O", "OD1").when(role == "CYS_S", "SG").when(F.col("idx") % 5 == 4, "CA").otherwise("NE2")
    element = F.when(role == "ASP_O", "O").when(role == "CYS_S", "S").when(F.col("idx") % 5 == 4, "C").otherwise("N")
    chain = F.when((F.col("sid") % 7 == 0) & (F.col("idx") >= 14), "B").otherwise("A")
    b = F.abs(F.element_at("embedding", F.col("idx") + 1).cast("double")) * 400
    return e.select(
        "sid", "idx", (F.floor(F.col("idx") / 2)).cast("int").alias("res_id"), role.alias("role"), res.alias("res_name"), atom.alias("atom_name"), element.alias("element"), chain.alias("chain_id"),
        b.alias("b_factor"), at[0].alias("x"), at[1].alias("y"), at[2].alias("z"),
    ).hint("merge")


ATOM_SQL = """atom AS (
  SELECT vec_id AS sid, j AS idx, j // 2 AS res_id,
    CASE WHEN j % 5 = 0 THEN 'ASP_O' WHEN j % 5 = 1 THEN 'CYS_S' ELSE 'HIS_N' END AS role,
    CASE WHEN j % 5 = 0 THEN 'ASP' WHEN j % 5 = 1 THEN 'CYS' ELSE 'HIS' END AS res_name,
    CASE WHEN j % 5 = 0 THEN 'OD1' WHEN j % 5 = 1 THEN 'SG' WHEN j % 5 = 4 THEN 'CA' ELSE 'NE2' END AS atom_name,
    CASE WHEN j % 5 = 0 THEN 'O' WHEN j % 5 = 1 THEN 'S' WHEN j % 5 = 4 THEN 'C' ELSE 'N' END AS element,
    CASE WHEN vec_id % 7 = 0 AND j >= 14 THEN 'B' ELSE 'A' END AS chain_id,
    abs(embedding[j + 1]::DOUBLE) * 400 AS b_factor,
    embedding[3 * j + 1]::DOUBLE * 20 AS x, embedding[3 * j + 2]::DOUBLE * 20 AS y, embedding[3 * j + 3]::DOUBLE * 20 AS z
  FROM embeddings, unnest(range(0, 21)) AS t(j))"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, site_idx, probability, x, y, z: none, one or two sites a vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sid"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("site_idx"))
    at = [F.element_at("embedding", F.col("site_idx") * 3 + 55 + k).cast("double") * 20 for k in range(3)]
    p = F.least(F.lit(1.0), F.abs(F.element_at("embedding", 64 - F.col("site_idx")).cast("double")) * 8)
    rows = e.where((F.col("sid") % 5 != 0) & ((F.col("site_idx") == 0) | (F.col("sid") % 3 != 0)))
    return rows.select("sid", "site_idx", p.alias("probability"), at[0].alias("x"), at[1].alias("y"), at[2].alias("z"))


SITE_SQL = """site AS (
  SELECT vec_id AS sid, s AS site_idx, least(1.0, abs(embedding[64 - s]::DOUBLE) * 8) AS probability,
    embedding[3 * s + 55]::DOUBLE * 20 AS x, embedding[3 * s + 56]::DOUBLE * 20 AS y, embedding[3 * s + 57]::DOUBLE * 20 AS z
  FROM embeddings, unnest(range(0, 2)) AS t(s) WHERE vec_id % 5 <> 0 AND (s = 0 OR vec_id % 3 <> 0))"""


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, label (positive or negative), family, subclass, tier."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sid"), F.when(F.col("label") % 3 == 0, "positive").otherwise("negative").alias("label"),
        F.when(F.col("label") == 4, "").otherwise(F.concat(F.lit("fam"), F.col("label"))).alias("family"),
        F.when(F.col("label") % 3 == 0, F.concat(F.lit("B"), (F.col("label") / 3).cast("int"))).alias("subclass"), (F.col("vec_id") % 4 + 1).cast("int").alias("tier"),
    )


STRUCT_SQL = """structure AS (
  SELECT vec_id AS sid, CASE WHEN label % 3 = 0 THEN 'positive' ELSE 'negative' END AS label,
    CASE WHEN label = 4 THEN '' ELSE 'fam' || label END AS family, CASE WHEN label % 3 = 0 THEN 'B' || (label // 3) END AS subclass, (vec_id % 4 + 1)::INT AS tier
  FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v (array of doubles), part (query or train), label, seed."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda z: z.cast("double")).alias("v"), F.when(F.col("vec_id") % 5 == 0, "query").otherwise("train").alias("part"),
        F.when(F.col("label") % 3 == 0, "positive").otherwise("negative").alias("label"), F.concat(F.lit("fam"), F.col("label")).alias("family"),
    )


VEC_SQL = """vec AS (
  SELECT vec_id AS id, list_transform(embedding, lambda z: z::DOUBLE) AS v, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'train' END AS part,
    CASE WHEN label % 3 = 0 THEN 'positive' ELSE 'negative' END AS label, 'fam' || label AS family FROM embeddings)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, identity, coverage, tm: customers and suppliers of orders as similarity pairs between parts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), "l_quantity", "l_discount", "l_tax")
    # Shuffles join small partitions to about one a core, so a task would grow with the input; its lines are fixed instead.
    n = ceil(li.count() / LINES)
    dealt = (lambda rows, *keys: rows.repartition(n, *keys)) if n > spark.sparkContext.defaultParallelism else (lambda rows, *_: rows)
    li = dealt(li, "l_orderkey")
    a = li.select("l_orderkey", F.col("part").alias("a"), F.col("l_quantity").alias("qa"), F.col("l_discount").alias("da"), F.col("l_tax").alias("ta"))
    b = li.select("l_orderkey", F.col("part").alias("b"), F.col("l_quantity").alias("qb"), F.col("l_discount").alias("db"), F.col("l_tax").alias("tb"))
    both = a.join(b, "l_orderkey").where("a < b")
    return dealt(both, "a", "b").groupBy("a", "b").agg(
        F.max(F.least("qa", "qb") / F.greatest("qa", "qb")).alias("identity"), F.max(1 - F.abs(F.col("da") - F.col("db")) * 5).alias("coverage"), F.max(1 - F.abs(F.col("ta") - F.col("tb")) * 10).alias("tm")
    )


PAIR_SQL = """pair AS (
  SELECT a, b, max(least(qa, qb) / greatest(qa, qb)) AS identity, max(1 - abs(da - db) * 5) AS coverage, max(1 - abs(ta - tb) * 10) AS tm
  FROM (SELECT l_orderkey, l_partkey AS a, l_quantity AS qa, l_discount AS da, l_tax AS ta FROM lineitem)
  JOIN (SELECT l_orderkey, l_partkey AS b, l_quantity AS qb, l_discount AS db, l_tax AS tb FROM lineitem) USING (l_orderkey)
  WHERE a < b GROUP BY a, b)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, id, truth, status (supported, not_supported, unavailable), family, panel: three methods' calls on
    line items."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").alias("truth"), "l_quantity", "l_discount", "l_tax",
        F.col("l_returnflag").alias("panel"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("f"), (F.col("l_suppkey") % 6).cast("string"))).alias("family"),
    )
    status = lambda hit, miss: F.when(miss, "unavailable").when(hit, "supported").otherwise("not_supported")
    methods = F.array(
        F.struct(F.lit("geometry").alias("method"), status(F.col("l_quantity") > 25, F.col("l_tax") > 0.07).alias("status")),
        F.struct(F.lit("profile").alias("method"), status(F.col("l_discount") >= 0.05, F.lit(False)).alias("status")),
        F.struct(F.lit("nearest").alias("method"), status(F.col("l_quantity") * F.col("l_discount") > 1.2, F.col("l_quantity") == 1).alias("status")),
    )
    return base.select("id", "truth", "panel", "family", F.explode(methods).alias("m")).select("m.method", "id", "truth", "m.status", "family", "panel")


CALL_SQL = """call AS (
  SELECT method, id, truth, CASE method WHEN 'geometry' THEN CASE WHEN l_tax > 0.07 THEN 'unavailable' WHEN l_quantity > 25 THEN 'supported' ELSE 'not_supported' END
      WHEN 'profile' THEN CASE WHEN l_discount >= 0.05 THEN 'supported' ELSE 'not_supported' END
      ELSE CASE WHEN l_quantity = 1 THEN 'unavailable' WHEN l_quantity * l_discount > 1.2 THEN 'supported' ELSE 'not_supported' END END AS status, family, panel
  FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'R' AS truth, l_quantity, l_discount, l_tax, l_returnflag AS panel,
          CASE WHEN l_linestatus = 'O' THEN '' ELSE 'f' || (l_suppkey % 6) END AS family FROM lineitem),
    (VALUES ('geometry'), ('profile'), ('nearest')) AS m(method))"""
