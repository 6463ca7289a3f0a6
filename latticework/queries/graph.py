"""Graph and split queries on part pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import sequences
from ..operators.graph import _checkpoint
from ..operators.ordered import sorted_digest
from ..plans.views import PAIR_SQL, pairs, table

#: Least identity and coverage of an edge; thresholds of the sweep, whose edges need full coverage.
ID, COV = 0.98, 0.95
SWEEP, SWEEP_COV = (0.94, 0.96, 0.98, 1.0), 0.999


def _ids(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_type").alias("family"), F.col("p_size").alias("size"))


def _edges(spark, d, identity=ID):
    return pairs(spark, d).where((F.col("identity") >= identity) & (F.col("coverage") >= COV))


def _labelled(spark, d):
    ids = _ids(spark, d)
    return g.components(ids, _edges(spark, d)).join(ids, "id")


def gr1(spark, d):
    return pairs(spark, d).where((F.col("identity") >= 0.3) & (F.col("coverage") >= 0.8)).groupBy((F.col("a") % 20).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("identity"), 6).alias("mean"))


def gr2(spark, d):
    return pairs(spark, d).where((F.col("tm") >= 0.5) & (F.col("coverage") >= 0.8)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tm") >= 0.65).alias("n_redundant"))


def gr3(spark, d):
    return g.components(_ids(spark, d), _edges(spark, d))


def gr4(spark, d):
    return g.threshold_sweep(_ids(spark, d), pairs(spark, d), SWEEP, SWEEP_COV)


def gr5(spark, d):
    return _labelled(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"), F.count_distinct("family").alias("n_families"), F.max("size").alias("largest"), F.min("id").alias("first"))


def gr6(spark, d):
    c = _labelled(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 45).alias("pos"), F.bool_or(F.col("id") % 50 == 0).alias("ref"))
    return c.agg(F.count(F.lit(1)).alias("n_components"), F.sum("pos").alias("n_positive"), F.count_if(F.col("pos") > 0).alias("positive_components"), F.sum(F.when(F.col("ref"), F.col("pos")).otherwise(0)).alias("positives_with_reference"))


def gr7(spark, d):
    m = _labelled(spark, d).where("family <> ''").groupBy("component", "family").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return m.groupBy("component").agg(F.max_by("family", F.struct("n", -F.col("first"))).alias("family"))


def gr8(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_brand").alias("component")).agg(F.min("p_type").alias("family"), F.count(F.lit(1)).alias("size"))
    return g.greedy_balance(b, 3)


def gr9(spark, d):
    """Panels: the two components with the most positives and the rest; sizes of test and train."""
    c = _labelled(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 45).alias("pos"))
    c = _checkpoint(c)
    top = {r.component: f"top{k + 1}" for k, r in enumerate(c.where("pos > 0").orderBy(F.desc("pos"), "component").limit(2).collect())}
    panel = F.coalesce(*(F.when(F.col("component") == k, v) for k, v in top.items()), F.lit("rest"))
    t = c.where("pos > 0").groupBy(panel.alias("panel")).agg(F.sum("n").alias("n_test"), F.sum("pos").alias("n_positive"))
    total = c.agg(F.sum("n").alias("all"))
    return t.join(F.broadcast(total), F.lit(True)).select("panel", "n_test", "n_positive", (F.col("all") - F.col("n_test")).alias("n_train"))


def gr10(spark, d):
    """Leave one family out: every component with any member of it is held out."""
    m = _labelled(spark, d)
    held = m.select("family", "component").distinct()
    size = m.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    own = m.groupBy("family").agg(F.count(F.lit(1)).alias("n_own"))
    return held.join(size, "component").groupBy("family").agg(F.sum("n").alias("n_held")).join(own, "family").select("family", "n_held", (F.col("n_held") - F.col("n_own")).alias("collateral"))


def gr11(spark, d):
    c = g.components(_ids(spark, d), _edges(spark, d))
    s = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return c.join(s, "component").groupBy(F.when(F.col("n") == 1, "test").otherwise("train").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def gr12(spark, d):
    """Integrity: components that straddle a split by component (none) and one by id (some)."""
    c = g.components(_ids(spark, d), _edges(spark, d)).select("id", "component", (F.col("component") % 3).alias("by_component"), (F.col("id") % 3).alias("by_id"))
    s = c.groupBy("component").agg(F.count_distinct("by_component").alias("a"), F.count_distinct("by_id").alias("b"))
    return s.agg(F.count_if(F.col("a") > 1).alias("straddle_component"), F.count_if(F.col("b") > 1).alias("straddle_id"))


def gr13(spark, d):
    ids = _ids(spark, d)
    m = g.best_match(ids.where("id % 5 = 0"), ids.where("id % 5 <> 0"), pairs(spark, d), "identity", F.col("coverage") >= 0.9)
    return m.select("id", F.round("best", 6).alias("best"), "nearest")


def gr14(spark, d):
    p = pairs(spark, d).where((F.col("identity") >= 0.3) & (F.col("coverage") >= 0.8)).where("(a % 5 = 0) <> (b % 5 = 0)")
    return p.agg(F.count(F.lit(1)).alias("n_leaks"))


def gr15(spark, d):
    m = gr13(spark, d)
    return m.agg(F.round(F.max("best"), 4).alias("max"), F.round(F.avg("best"), 4).alias("mean"), F.count_if(F.col("best") < 0.95).alias("n_below"))


def gr16(spark, d):
    h = pairs(spark, d).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return h.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.avg("n"), 1).alias("mean"), F.count_if(F.col("n") >= 300).alias("at_cap"))


def gr17(spark, d):
    m = _ids(spark, d).withColumn("panel", F.col("id") % 4)
    return m.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 45).alias("n_positive"), F.count_distinct("family").alias("n_families"))


def gr18(spark, d):
    m = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    return m.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", -F.col("first"))).alias("stratum"))


def gr19(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("cluster"), F.col("p_type").alias("stratum"))
    return g.stratified_folds(c, 5, 17).select("cluster", "stratum", "fold")


def gr20(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    return g.carve_validation(s, 0.15)


def gr21(spark, d):
    """Sensitivity by identity bin; the last bin also takes what no other does."""
    m = gr13(spark, d)
    band = F.when(F.col("best") == 0, "no_qualifying_hit").when(F.col("best") <= 0.9, "low").when(F.col("best") <= 0.96, "mid").otherwise("high")
    return m.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("id") % 3 == 0).cast("int")), 6).alias("sensitivity"))


def gr22(spark, d):
    """Documents as sequences of words, all against all; the edges of GR1 are marked."""
    found = sequences.search(table(spark, d, "documents").select(F.col("doc_id").alias("id"), sequences.words(F.col("text")).alias("s")))
    edge = (F.col("identity") >= 0.3) & (F.least("query_coverage", "target_coverage") >= 0.8)
    return found.select(F.col("a").alias("query"), F.col("b").alias("target"), F.round("identity", 6).alias("identity"), F.round("query_coverage", 6).alias("query_coverage"), F.round("target_coverage", 6).alias("target_coverage"), edge.alias("edge"))


def gr23(spark, d):
    """Directory hash: names and file hashes in order, with count and bytes; a source is a directory."""
    x = table(spark, d, "documents").select("source", F.concat_ws(":", "doc_id", F.sha2("text", 256)).alias("e"), "doc_id", F.octet_length("text").alias("b"))
    sums = x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes"))
    return sorted_digest(x, "source", ["doc_id"], "e", "\n").join(sums, "source")


def gr24(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def gr25(spark, d):
    """Content hash that does not depend on row or column order of the container."""
    c = table(spark, d, "customer").select(F.col("c_nationkey"), F.concat_ws("|", F.lit("c_custkey"), "c_custkey", F.lit("c_mktsegment"), "c_mktsegment").alias("r"))
    return sorted_digest(c, "c_nationkey", ["r"], "r", "\n")


def gr26(spark, d):
    f = gr19(spark, d).withColumn("part", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train"))
    return f.groupBy("stratum").pivot("part", ["test", "train", "val"]).agg(F.count(F.lit(1)))


QUERIES = {
    "gr1_sequence_edges": gr1, "gr2_structure_edges": gr2, "gr3_components": gr3, "gr4_threshold_sweep": gr4, "gr5_composition": gr5, "gr6_feasibility": gr6, "gr7_dominant_family": gr7, "gr8_greedy_balance": gr8, "gr9_panels": gr9,
    "gr10_leave_family_out": gr10, "gr11_operational_split": gr11, "gr12_integrity": gr12, "gr13_similarity_audit": gr13, "gr14_leaks": gr14, "gr15_identity_distribution": gr15, "gr16_search_completeness": gr16,
    "gr17_panel_composition": gr17, "gr18_majority_stratum": gr18, "gr19_stratified_folds": gr19, "gr20_validation_carve": gr20, "gr21_identity_bins": gr21, "gr22_sequence_search": gr22, "gr23_directory_hash": gr23, "gr24_file_hash": gr24,
    "gr25_content_hash": gr25, "gr26_fold_pivot": gr26,
}

_IDS = "ids AS (SELECT p_partkey AS id, p_brand AS label, p_type AS family, p_size AS size FROM part)"
_E = f"ed AS MATERIALIZED (SELECT a, b FROM pair WHERE identity >= {ID} AND coverage >= {COV})"
_C = "ud AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (SELECT id AS node, id AS r FROM ids UNION SELECT reach.node, ud.b FROM reach JOIN ud ON ud.a = reach.r), comp AS MATERIALIZED (SELECT node AS id, min(r) AS component FROM reach GROUP BY node), m AS (SELECT * FROM comp JOIN ids USING (id))"
_B = f"WITH RECURSIVE {PAIR_SQL}, {_IDS}, {_E}, {_C}"
_G13 = f"{PAIR_SQL}, {_IDS}, bp AS (SELECT a, b, identity, coverage FROM pair UNION ALL SELECT b, a, identity, coverage FROM pair), bm AS (SELECT ids.id, coalesce(max(identity), 0) AS best, arg_min(b, (-identity, b)) AS nearest FROM ids LEFT JOIN bp ON bp.a = ids.id AND coverage >= 0.9 AND b % 5 <> 0 AND b IN (SELECT id FROM ids) AND identity > 0 WHERE ids.id % 5 = 0 GROUP BY ids.id)"
_FOLD = "fold AS (SELECT p_partkey AS cluster, p_type AS stratum, (row_number() OVER (PARTITION BY p_type ORDER BY sha256('17:' || p_partkey), p_partkey) - 1) % 5 AS fold FROM part)"
ORACLE_SQL = {
    "gr1_sequence_edges": f"WITH {PAIR_SQL} SELECT a % 20 AS k, count(*) AS n, round(avg(identity), 6) AS mean FROM pair WHERE identity >= 0.3 AND coverage >= 0.8 GROUP BY 1",
    "gr2_structure_edges": f"WITH {PAIR_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE tm >= 0.65) AS n_redundant FROM pair WHERE tm >= 0.5 AND coverage >= 0.8",
    "gr3_components": f"{_B} SELECT id, component FROM comp",
    "gr4_threshold_sweep": f"""WITH RECURSIVE {PAIR_SQL}, {_IDS}, t AS (SELECT unnest({list(SWEEP)}::DOUBLE[]) AS t), ed AS MATERIALIZED (SELECT t, a, b FROM pair, t WHERE identity >= t AND coverage >= {SWEEP_COV} AND a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)),
      ud AS (SELECT t, a, b FROM ed UNION SELECT t, b, a FROM ed), reach AS (SELECT t, id AS node, id AS r FROM ids, t UNION SELECT reach.t, reach.node, ud.b FROM reach JOIN ud ON ud.a = reach.r AND ud.t = reach.t),
      c AS (SELECT t, node, min(r) AS c FROM reach GROUP BY ALL), s AS (SELECT t, c, count(*) AS n FROM c GROUP BY ALL) SELECT t AS threshold, count(*) AS n_components, max(n) AS largest FROM s GROUP BY t""",
    "gr5_composition": f"{_B} SELECT component, count(*) AS n, count(DISTINCT label) AS n_labels, count(DISTINCT family) AS n_families, max(size) AS largest, min(id) AS first FROM m GROUP BY component",
    "gr6_feasibility": f"""{_B}, c AS (SELECT component, count(*) FILTER (WHERE size > 45) AS pos, bool_or(id % 50 = 0) AS ref FROM m GROUP BY component)
      SELECT count(*) AS n_components, sum(pos)::BIGINT AS n_positive, count(*) FILTER (WHERE pos > 0) AS positive_components, sum(CASE WHEN ref THEN pos ELSE 0 END)::BIGINT AS positives_with_reference FROM c""",
    "gr7_dominant_family": f"{_B}, f AS (SELECT component, family, count(*) AS n, min(id) AS i FROM m WHERE family <> '' GROUP BY ALL) SELECT component, arg_max(family, (n, -i)) AS family FROM f GROUP BY component",
    "gr9_panels": f"""{_B}, c AS (SELECT component, count(*) AS n, count(*) FILTER (WHERE size > 45) AS pos FROM m GROUP BY component), r AS (SELECT *, row_number() OVER (ORDER BY pos DESC, component) AS r FROM c WHERE pos > 0)
      SELECT CASE WHEN r <= 2 THEN 'top' || r ELSE 'rest' END AS panel, sum(n)::BIGINT AS n_test, sum(pos)::BIGINT AS n_positive, ((SELECT sum(n) FROM c) - sum(n))::BIGINT AS n_train FROM r GROUP BY 1""",
    "gr10_leave_family_out": f"""{_B}, h AS (SELECT DISTINCT family, component FROM m), s AS (SELECT component, count(*) AS n FROM m GROUP BY component), o AS (SELECT family, count(*) AS k FROM m GROUP BY family)
      SELECT family, sum(n)::BIGINT AS n_held, (sum(n) - any_value(k))::BIGINT AS collateral FROM h JOIN s USING (component) JOIN o USING (family) GROUP BY family""",
    "gr11_operational_split": f"{_B}, s AS (SELECT component, count(*) AS n FROM comp GROUP BY component) SELECT CASE WHEN n = 1 THEN 'test' ELSE 'train' END AS partition, sum(n)::BIGINT AS n FROM s GROUP BY 1",
    "gr12_integrity": f"{_B}, s AS (SELECT component, count(DISTINCT component % 3) AS a, count(DISTINCT id % 3) AS b FROM comp GROUP BY component) SELECT count(*) FILTER (WHERE a > 1) AS straddle_component, count(*) FILTER (WHERE b > 1) AS straddle_id FROM s",
    "gr13_similarity_audit": f"WITH {_G13} SELECT id, round(best, 6) AS best, nearest FROM bm",
    "gr14_leaks": f"WITH {PAIR_SQL} SELECT count(*) AS n_leaks FROM pair WHERE identity >= 0.3 AND coverage >= 0.8 AND (a % 5 = 0) <> (b % 5 = 0)",
    "gr15_identity_distribution": f"WITH {_G13} SELECT round(max(best), 4) AS max, round(avg(round(best, 6)), 4) AS mean, count(*) FILTER (WHERE round(best, 6) < 0.95) AS n_below FROM bm",
    "gr16_search_completeness": f"WITH {PAIR_SQL}, h AS (SELECT a, count(*) AS n FROM pair GROUP BY a) SELECT min(n) AS min, max(n) AS max, round(avg(n), 1) AS mean, count(*) FILTER (WHERE n >= 300) AS at_cap FROM h",
    "gr17_panel_composition": f"WITH {_IDS} SELECT id % 4 AS panel, count(*) AS n, count(*) FILTER (WHERE size > 45) AS n_positive, count(DISTINCT family) AS n_families FROM ids GROUP BY 1",
    "gr18_majority_stratum": "WITH m AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL) SELECT p_brand, arg_max(p_type, (n, -f)) AS stratum FROM m GROUP BY p_brand",
    "gr19_stratified_folds": f"WITH {_FOLD} SELECT * FROM fold",
    "gr20_validation_carve": "WITH s AS (SELECT o_custkey AS component, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT component, n FROM r WHERE before < floor(0.15 * (SELECT sum(n) FROM s))",
    "gr21_identity_bins": f"WITH {_G13} SELECT CASE WHEN round(best, 6) = 0 THEN 'no_qualifying_hit' WHEN round(best, 6) <= 0.9 THEN 'low' WHEN round(best, 6) <= 0.96 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, round(avg((id % 3 = 0)::INT), 6) AS sensitivity FROM bm GROUP BY 1",
    "gr23_directory_hash": "SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source",
    "gr24_file_hash": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "gr25_content_hash": "SELECT c_nationkey, sha256(string_agg('c_custkey|' || c_custkey || '|c_mktsegment|' || c_mktsegment, chr(10) ORDER BY 'c_custkey|' || c_custkey || '|c_mktsegment|' || c_mktsegment)) AS digest FROM customer GROUP BY c_nationkey",
    "gr26_fold_pivot": f"WITH {_FOLD} SELECT stratum, count(*) FILTER (WHERE fold = 0) AS test, count(*) FILTER (WHERE fold > 1) AS train, count(*) FILTER (WHERE fold = 1) AS val FROM fold GROUP BY stratum",
}
