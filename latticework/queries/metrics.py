"""Metric, window and set queries on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import neighbours as nn
from ..operators.ordered import before, upper_median
from ..plans.views import CALL_SQL, calls, table




def _counts(spark, d, *keys):
    return calls(spark, d).groupBy(*keys).agg(*m.confusion(F.col("status") == "supported", F.col("truth")))


def mt1(spark, d):
    return m.rates(_counts(spark, d, "method", "panel"), ["method", "panel"])


def mt2(spark, d):
    return m.rates(_counts(spark, d, "method", "panel"), ["method", "panel"], "one")


def mt3(spark, d):
    return m.rates(_counts(spark, d, "method", "panel"), ["method", "panel"], "mixed")


def mt4(spark, d):
    return m.abstaining(calls(spark, d), "method")


def mt5(spark, d):
    members = calls(spark, d).where("method = 'profile'").select("id", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 3 == 0, "third"), F.when(F.col("panel") != "A", "not_a"), F.when(F.col("family") == "", "no_family")))).alias("population"))
    return m.by_population(calls(spark, d), members)


def mt6(spark, d):
    c = calls(spark, d)
    y = F.col("status") == "supported"
    return c.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(y == F.col("truth")).alias("correct"), F.round(F.avg((y == F.col("truth")).cast("int")), 6).alias("rate"), F.count_if(y).alias("positive_calls"))


def mt7(spark, d):
    return m.false_by_family(calls(spark, d), "method")


def mt8(spark, d):
    return m.recovered(calls(spark, d), "profile", "geometry")


def mt9(spark, d):
    return calls(spark, d).groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


def mt10(spark, d):
    u = F.col("status") == "unavailable"
    return calls(spark, d).groupBy("method", "panel").agg(F.count_if(u).alias("n_unavailable"), F.round(F.avg(u.cast("int")), 4).alias("fraction"))


def mt11(spark, d):
    """Frozen gate: every check must hold; an undefined figure fails it."""
    r = m.rates(_counts(spark, d, "method"), ["method"])
    ok = lambda c: F.coalesce(c, F.lit(False))
    checks = {"sensitive": ok(F.col("sensitivity") >= 0.4), "specific": ok(F.col("specificity") >= 0.45), "balanced": ok(F.col("balanced_accuracy") >= 0.48), "enough": F.col("n") >= 100}
    every = checks["sensitive"] & checks["specific"] & checks["balanced"] & checks["enough"]
    return r.select("method", *(c.alias(n) for n, c in checks.items()), every.alias("go"))


def mt12(spark, d):
    mid = F.col("upper_median")
    return upper_median(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round(mid, 2).alias("upper_median"), (mid < 150000).alias("accepted"))


def mt14(spark, d):
    c = calls(spark, d).where("status <> 'unavailable'").withColumn("hit", ((F.col("status") == "supported") == F.col("truth")).cast("int"))
    return c.groupBy("method").agg(F.round(F.sum("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("rate"))


def mt19(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("min"), F.max(F.length("text")).alias("max"))


def mt21(spark, d):
    c = calls(spark, d).withColumn("tier", F.col("id") % 4 + 1).groupBy("tier", "method").agg(*m.confusion(F.col("status") == "supported", F.col("truth")))
    return m.rates(c, ["tier", "method"], "one")


def mt22(spark, d):
    p = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("min"), F.max("p_retailprice").alias("max"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 6).alias("std"))
    return p.join(upper_median(table(spark, d, "part"), "p_type", "p_retailprice"), "p_type")


def gb4(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return nn.majority(e, "user_id", "event_type", "event_id")


def wi1(spark, d):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(by)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


def wi2(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(-F.col("l_extendedprice"), "l_linenumber")).alias("best"))


def wi3(spark, d):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    o = table(spark, d, "orders").withColumn("before", F.coalesce(F.sum("o_totalprice").over(by), F.lit(0.0)))
    return o.where("before < 300000").select("o_custkey", "o_orderkey", F.round("before", 2).alias("before"))


def wi4(spark, d):
    """Slots in turn inside each nation: the places of one ordered pass, less those of the nation's first customer."""
    placed = before(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], "at")
    first = placed.groupBy("c_nationkey").agg(F.min("at").alias("first"))
    return placed.join(first, "c_nationkey").select("c_custkey", ((F.col("at") - F.col("first")) % 4).alias("slot"))


def wi5(spark, d):
    p = table(spark, d, "part")
    out = nn.percentile_below(p.where("p_partkey % 4 = 0").select("p_partkey", "p_retailprice"), "p_retailprice", p.where("p_partkey % 4 <> 0").select(F.col("p_retailprice").alias("c")), "c")
    return out.select("p_partkey", F.round("percentile", 6).alias("percentile"))


def wi6(spark, d):
    """Neighbours by key offset: an equi-join on the key, so gaps stay gaps."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 2).alias("l_linenumber"), F.col("l_quantity").alias("after"))
    return li.join(nxt, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("after") - F.col("l_quantity")).alias("step"))


def wi7(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")))


def wi8(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def wi9(spark, d):
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(by)).where("r = 1").select("user_id", "event_type", "event_id")


def se1(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("lang = 'fr'").select("doc_id")
    return a.union(b).distinct()


def se2(spark, d):
    return table(spark, d, "labels").select("doc_id").intersect(table(spark, d, "documents").where("lang = 'en'").select("doc_id"))


def se3(spark, d):
    a, b = table(spark, d, "documents").where("lang = 'en'").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.exceptAll(b).select("doc_id", F.lit("left").alias("side")).union(b.exceptAll(a).select("doc_id", F.lit("right").alias("side")))


def se4(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct(), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    left, right = a.join(b, "k", "left_anti").agg(F.count(F.lit(1)).alias("only_left")), b.join(a, "k", "left_anti").agg(F.count(F.lit(1)).alias("only_right"))
    return left.crossJoin(right).select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def se5(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id")
    return a.join(b, "doc_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("is_subset"))


QUERIES = {
    "mt1_rates_null": mt1, "mt2_rates_one": mt2, "mt3_rates_mixed": mt3, "mt4_abstention": mt4, "mt5_populations": mt5, "mt6_rate_summary": mt6, "mt7_false_by_family": mt7, "mt8_recovered": mt8, "mt9_status_histogram": mt9,
    "mt10_coverage": mt10, "mt11_gate": mt11, "mt12_acceptance": mt12, "mt14_rate_over_ids": mt14, "mt19_lengths": mt19, "mt21_by_tier": mt21, "mt22_summary": mt22, "gb4_majority": gb4,
    "wi1_top_k": wi1, "wi2_best": wi2, "wi3_running_stop": wi3, "wi4_round_robin": wi4, "wi5_percentile": wi5, "wi6_key_offset": wi6, "wi7_by_size": wi7, "wi8_limit": wi8, "wi9_keep_first": wi9,
    "se1_union": se1, "se2_intersect": se2, "se3_except": se3, "se4_set_equality": se4, "se5_subset": se5,
}

_CF = "count(*) FILTER (WHERE truth AND status = 'supported') AS tp, count(*) FILTER (WHERE NOT truth AND status <> 'supported') AS tn, count(*) FILTER (WHERE NOT truth AND status = 'supported') AS fp, count(*) FILTER (WHERE truth AND status <> 'supported') AS fn"


def _rate_sql(keys: str, src: str, sens: str, spec: str, more: str = "") -> str:
    return f"SELECT {keys}, tp, tn, fp, fn, tp + tn + fp + fn AS n, round({sens}, 6) AS sensitivity, round({spec}, 6) AS specificity, round(({sens} + {spec}) / 2, 6) AS balanced_accuracy{more} FROM ({src})"


_NS, _NP = "tp / nullif(tp + fn, 0)", "tn / nullif(tn + fp, 0)"
_OS, _OP = "tp / greatest(tp + fn, 1)", "tn / greatest(tn + fp, 1)"
_ACC = ", round((tp + tn) / greatest(tp + tn + fp + fn, 1), 6) AS accuracy"
_MP = f"SELECT method, panel, {_CF} FROM call GROUP BY method, panel"
ORACLE_SQL = {
    "mt1_rates_null": f"WITH {CALL_SQL} {_rate_sql('method, panel', _MP, _NS, _NP)}",
    "mt2_rates_one": f"WITH {CALL_SQL} {_rate_sql('method, panel', _MP, _OS, _OP, _ACC)}",
    "mt3_rates_mixed": f"WITH {CALL_SQL} {_rate_sql('method, panel', _MP, _NS, _OP)}",
    "mt4_abstention": f"""WITH {CALL_SQL} SELECT method, count(*) FILTER (WHERE truth AND status = 'supported') AS tp, count(*) FILTER (WHERE NOT truth AND status = 'not_supported') AS tn, count(*) FILTER (WHERE NOT truth AND status = 'supported') AS fp,
      count(*) FILTER (WHERE truth AND status = 'not_supported') AS fn, round(avg((status <> 'unavailable')::INT), 6) AS evaluable, round(count(*) FILTER (WHERE truth AND status = 'supported') / nullif(count(*) FILTER (WHERE truth), 0), 6) AS end_to_end,
      round(count(*) FILTER (WHERE NOT truth AND status = 'supported') / nullif(count(*) FILTER (WHERE NOT truth), 0), 6) AS false_rate FROM call GROUP BY method""",
    "mt5_populations": f"""WITH {CALL_SQL}, mem AS (SELECT id, 'all' AS population FROM call WHERE method = 'profile' UNION ALL SELECT id, 'third' FROM call WHERE method = 'profile' AND id % 3 = 0 UNION ALL SELECT id, 'not_a' FROM call WHERE method = 'profile' AND panel <> 'A'
      UNION ALL SELECT id, 'no_family' FROM call WHERE method = 'profile' AND family = '') {_rate_sql('method, population', f'SELECT method, population, {_CF} FROM call JOIN mem USING (id) GROUP BY ALL', _NS, _NP)}""",
    "mt6_rate_summary": f"WITH {CALL_SQL} SELECT method, count(*) AS n, count(*) FILTER (WHERE (status = 'supported') = truth) AS correct, round(avg(((status = 'supported') = truth)::INT), 6) AS rate, count(*) FILTER (WHERE status = 'supported') AS positive_calls FROM call GROUP BY method",
    "mt7_false_by_family": f"WITH {CALL_SQL} SELECT method, coalesce(nullif(family, ''), 'unknown') AS family, count(*) AS n, count(*) FILTER (WHERE status = 'supported') AS fp, round(avg((status = 'supported')::INT), 6) AS rate, count(*) FILTER (WHERE status = 'unavailable') AS n_unavailable FROM call WHERE NOT truth GROUP BY 1, 2",
    "mt8_recovered": f"WITH {CALL_SQL} SELECT id FROM call WHERE truth GROUP BY id HAVING bool_or(method = 'geometry' AND status = 'supported') AND NOT bool_or(method = 'profile' AND status = 'supported')",
    "mt9_status_histogram": f"WITH {CALL_SQL} SELECT method, status, count(*) AS n FROM call GROUP BY ALL",
    "mt10_coverage": f"WITH {CALL_SQL} SELECT method, panel, count(*) FILTER (WHERE status = 'unavailable') AS n_unavailable, round(avg((status = 'unavailable')::INT), 4) AS fraction FROM call GROUP BY ALL",
    "mt11_gate": f"""WITH {CALL_SQL}, r AS ({_rate_sql('method', f'SELECT method, {_CF} FROM call GROUP BY method', _NS, _NP)})
      SELECT method, coalesce(sensitivity >= 0.4, false) AS sensitive, coalesce(specificity >= 0.45, false) AS specific, coalesce(balanced_accuracy >= 0.48, false) AS balanced, n >= 100 AS enough,
        coalesce(sensitivity >= 0.4 AND specificity >= 0.45 AND balanced_accuracy >= 0.48, false) AND n >= 100 AS go FROM r""",
    "mt12_acceptance": "WITH l AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS l FROM orders GROUP BY 1) SELECT o_orderpriority, round(l[len(l) // 2 + 1], 2) AS upper_median, l[len(l) // 2 + 1] < 150000 AS accepted FROM l",
    "mt14_rate_over_ids": f"WITH {CALL_SQL} SELECT method, round(sum(((status = 'supported') = truth)::INT) / greatest(count(*), 1), 6) AS rate FROM call WHERE status <> 'unavailable' GROUP BY method",
    "mt19_lengths": "SELECT lang, count(*) AS n, min(length(text)) AS min, max(length(text)) AS max FROM documents GROUP BY lang",
    "mt21_by_tier": f"WITH {CALL_SQL} {_rate_sql('tier, method', f'SELECT id % 4 + 1 AS tier, method, {_CF} FROM call GROUP BY ALL', _OS, _OP, _ACC)}",
    "mt22_summary": "WITH g AS (SELECT p_type, list_sort(list(p_retailprice)) AS l, stddev_pop(p_retailprice) AS s, avg(p_retailprice) AS a FROM part GROUP BY 1) SELECT p_type, len(l) AS n, l[1] AS min, l[len(l)] AS max, round(a, 6) AS mean, round(s, 6) AS std, l[len(l) // 2 + 1] AS upper_median FROM g",
    "gb4_majority": "WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, -f)) AS pred FROM n GROUP BY user_id",
    "wi1_top_k": "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "wi2_best": "SELECT l_orderkey, arg_min(l_linenumber, (-l_extendedprice, l_linenumber)) AS best FROM lineitem GROUP BY l_orderkey",
    "wi3_running_stop": "SELECT o_custkey, o_orderkey, round(before, 2) AS before FROM (SELECT *, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 300000",
    "wi4_round_robin": "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS slot FROM customer",
    "wi5_percentile": "WITH c AS (SELECT p_retailprice AS c FROM part WHERE p_partkey % 4 <> 0) SELECT p_partkey, round((SELECT count(*) FROM c WHERE c < p_retailprice) / (SELECT count(*) FROM c), 6) AS percentile FROM part WHERE p_partkey % 4 = 0",
    "wi6_key_offset": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity - a.l_quantity AS step FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 2",
    "wi7_by_size": "SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS position FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)",
    "wi8_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "wi9_keep_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "se1_union": "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'fr'",
    "se2_intersect": "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'",
    "se3_except": "(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT ALL SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents WHERE lang = 'en'))",
    "se4_set_equality": "SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))) AS only_right)",
    "se5_subset": "SELECT count(*) = 0 AS is_subset FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
}
