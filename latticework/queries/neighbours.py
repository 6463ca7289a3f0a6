"""Neighbour queries on the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import distance_n
from ..operators import neighbours as nn
from ..operators import training
from ..operators.graph import _checkpoint as once
from ..sources.sinks import shared_folder
from ..plans.views import VEC_SQL, table, vectors

K = 5


def _split(spark, d):
    v = vectors(spark, d)
    return v.where("part = 'query'"), v.where("part = 'train'")


def _near(spark, d, k=K):
    q, t = _split(spark, d)
    return nn.nearest(q, t, k)


def kn1(spark, d):
    return nn.majority(_near(spark, d), "q").select(F.col("q").alias("id"), "pred")


def kn2(spark, d):
    q, _ = _split(spark, d)
    p = nn.majority(_near(spark, d), "q").join(q.select(F.col("id").alias("q"), F.col("label").alias("truth")), "q")
    return p.agg(F.round(F.avg((F.col("pred") == F.col("truth")).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def kn3(spark, d):
    q, _ = _split(spark, d)
    p = nn.majority(_near(spark, d), "q").join(q.select(F.col("id").alias("q"), F.col("label").alias("truth")), "q")
    t, y = F.col("truth") == "positive", F.col("pred") == "positive"
    c = p.agg(F.count_if(t & y).alias("tp"), F.count_if(~t & ~y).alias("tn"), F.count_if(~t & y).alias("fp"), F.count_if(t & ~y).alias("fn"))
    sens, spec = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1))
    return c.select("tp", "tn", "fp", "fn", F.round(sens, 6).alias("sensitivity"), F.round(spec, 6).alias("specificity"), F.round((sens + spec) / 2, 6).alias("balanced_accuracy"))


def kn4(spark, d):
    v = nn.vote_fraction(_near(spark, d, 6), F.col("label") == "positive")
    return v.select(F.col("q").alias("id"), F.round("fraction", 6).alias("fraction"), F.round("nearest", 6).alias("nearest"), "pred")


def _calibration(spark, d):
    _, t = _split(spark, d)
    return nn.nearest(t.select("id", "v"), t.select("id", "v"), 1, leave_self=True).select("q", F.col("d").alias("c"))


def kn5(spark, d):
    near = once(_near(spark, d))
    v = nn.vote_fraction(near, F.col("label") == "positive")
    listed = near.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string")), ",").alias("neighbours"))
    out = nn.percentile_below(v, "nearest", _calibration(spark, d), "c").join(listed, "q")
    return out.select(F.col("q").alias("id"), "pred", F.round("nearest", 4).alias("nearest"), F.round("percentile", 4).alias("percentile"), "neighbours")


def kn6(spark, d):
    return _calibration(spark, d).select(F.col("q").alias("id"), F.round("c", 6).alias("nearest"))


def kn7(spark, d):
    _, t = _split(spark, d)
    return nn.majority(nn.nearest(t, t, K, leave_self=True), "q").select(F.col("q").alias("id"), "pred")


def kn8(spark, d):
    """Recall at 1, 5, 10 and 20 from the rank of the first other positive."""
    v = vectors(spark, d)
    near = nn.nearest(v.where("label = 'positive'"), v, 20, leave_self=True)
    first = near.groupBy("q").agg(F.min(F.when(F.col("label") == "positive", F.col("rank"))).alias("r"))
    return first.agg(*(F.round(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("int")), 6).alias(f"recall{k}") for k in (1, 5, 10, 20)))


def kn9(spark, d):
    """Distance to the mean positive vector and its percentile among negatives' distances."""
    q, t = _split(spark, d)
    proto = nn.mean_vector(t.where("label = 'positive'")).select(F.col("v").alias("p"))
    far = lambda df: df.join(F.broadcast(proto), F.lit(True)).select("id", distance_n("v", "p").alias("d"))
    neg = far(t.where("label = 'negative'")).select(F.col("d").alias("c"))
    out = nn.percentile_below(far(q), "d", neg, "c")
    return out.select("id", F.round("d", 6).alias("distance"), F.round(100 * F.col("percentile"), 4).alias("percentile"))


def kn10(spark, d):
    q, t = _split(spark, d)
    proto = nn.mean_vector(t).select(F.col("v").alias("p"))
    near = nn.nearest(q, t, 1).select("q", F.col("d").alias("nearest"))
    out = q.join(F.broadcast(proto), F.lit(True)).select(F.col("id").alias("q"), distance_n("v", "p").alias("to_mean"))
    return near.join(out, "q").select(F.col("q").alias("id"), F.round("nearest", 6).alias("nearest"), F.round("to_mean", 6).alias("to_mean"))


def kn11(spark, d):
    n = nn.nearest(*_split(spark, d), 1).select("q", F.col("d").alias("n"))
    band = F.when(F.col("n") < 0.15, "near_duplicate").when(F.col("n") > 0.55, "too_divergent").otherwise("novelty_band")
    return n.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def kn12(spark, d):
    """The 25 most plausible candidates with their rank and the share above 0.6."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.abs(F.element_at("embedding", 1).cast("double")).alias("s"))
    top = e.orderBy(F.desc("s"), "id").limit(25)
    return top.select("id", F.round("s", 6).alias("score"), (F.col("s") > 0.3).alias("strong"))


def kn13(spark, d):
    """Nearest centroid of two classes."""
    q, t = _split(spark, d)
    c = nn.mean_vector(t, "label").select("label", F.col("v").alias("c"))
    j = q.drop("label").join(F.broadcast(c), F.lit(True)).select("id", "label", distance_n("v", "c").alias("d"))
    return j.groupBy("id").agg(F.min_by("label", F.struct("d", "label")).alias("pred"))


def kn14(spark, d):
    """Standardised prototypes by family; features below -0.2 are missing; root mean square over jointly valid
    features, at least three of them."""
    v = vectors(spark, d).select("id", "part", "family", F.posexplode("v").alias("f", "x")).withColumn("x", F.when(F.col("x") >= -0.2, F.col("x")))
    s = v.where("part = 'train'").groupBy("f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = v.join(F.broadcast(s), "f").select("id", "part", "family", "f", ((F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z"))
    proto = z.where("part = 'train'").groupBy("family", "f").agg(F.avg("z").alias("p"))
    j = z.where("part = 'query'").drop("family").join(F.broadcast(proto), "f").where("z is not null and p is not null")
    g = j.groupBy("id", "family").agg(F.sqrt(F.avg((F.col("z") - F.col("p")) * (F.col("z") - F.col("p")))).alias("d"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return g.groupBy("id").agg(F.min_by("family", F.struct(F.round("d", 9), "family")).alias("family"), F.round(F.min("d"), 5).alias("distance"))


def kn15(spark, d):
    v = vectors(spark, d)
    return nn.mean_vector(v, "family").select("family", F.round(F.element_at("v", 1), 6).alias("x1"), F.round(F.element_at("v", 64), 6).alias("x64"), F.size("v").alias("n"))


def kn16(spark, d):
    """Mean over seeds and the variance; seeds are four shifted copies of each vector's group."""
    v = vectors(spark, d).select((F.col("id") / 4).cast("long").alias("g"), F.posexplode("v").alias("pos", "x"))
    s = v.groupBy("g", "pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return s.groupBy("g").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("v"), 6).alias("variance"))


def _seeds(spark, d):
    e = table(spark, d, "embeddings")
    hit = lambda k: F.when(F.element_at("embedding", k).cast("double") > 0, "positive").when((F.col("vec_id") + k) % 9 == 0, None).otherwise("negative")
    return e.select(F.col("vec_id").alias("id"), F.col("label"), F.posexplode(F.array(*(hit(k) for k in range(1, 7)))).alias("seed", "pred"))


def kn17(spark, d):
    s = _seeds(spark, d).where("pred is not null").select(F.col("id"), "pred", "seed")
    return nn.majority(s.withColumnRenamed("pred", "vote"), "id", "vote", "seed")


def kn18(spark, d):
    s = _seeds(spark, d).where("pred is not null").withColumn("ok", ((F.col("pred") == "positive") == (F.col("label") % 3 == 0)).cast("int"))
    acc = s.groupBy("seed").agg(F.avg("ok").alias("a"))
    vals = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", F.round("a", 4).alias("a")))), lambda x: F.format_number(x["a"], 4)), " ")
    return acc.agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("std"), vals.alias("per_seed"))


def kn20(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.abs(F.element_at("embedding", 2).cast("double") * 4).alias("p"), F.abs(F.element_at("embedding", 3).cast("double") * 4).alias("b"))
    arg = F.col("p") > 0.5
    return e.select("id", arg.alias("arg"), F.when(arg, F.col("b") >= 0.5).alias("beta"))


def kn21(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 6 != 0, F.element_at("embedding", 4).cast("double") * 1000).alias("score"))
    return e.select("id", *(F.coalesce(F.col("score") > t, F.lit(False)).alias(n) for n, t in (("combined", 127.0), ("specific", 135.8))))


def kn22(spark, d):
    """Greatest similarity to known items: 0 without a hit, null where the search failed."""
    q, t = _split(spark, d)
    hits = nn.nearest(q.where("id % 3 <> 0"), t, 1).select("q", (1 / (1 + F.col("d"))).alias("tm")).where("tm > 0.5")
    j = q.select(F.col("id").alias("q")).join(hits, "q", "left")
    return j.select(F.col("q").alias("id"), F.when(F.col("q") % 40 != 0, F.round(F.coalesce("tm", F.lit(0.0)), 6)).alias("max_tm"))


def kn23(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", F.length(F.substring("text", 1, 1022)).alias("n1022"), F.least(F.length("text"), F.lit(199)).alias("n199"))


def kn24(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^GAVLIPFYWRSTCMNQDEKH]", "X").alias("s"))
    return x.select("doc_id", F.sha2("s", 256).alias("digest"), (F.length("s") - F.length(F.replace("s", F.lit("X")))).alias("n_x"))


def tr11(spark, d):
    """Six epochs of a linear encoder on the training vectors; the losses of each, and which epoch is chosen."""
    _, t = _split(spark, d)
    held = (F.col("id") % 5 == 1).alias("held")
    run = training.train(t.select("id", "v", "label", (F.col("id") % 4 + 1).cast("int").alias("tier"), held), shared_folder(spark, "epochs"), 6, rate=1.0)
    chosen, _ = training.best(run)
    return run.select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"), (F.col("epoch") == chosen).alias("chosen"))


QUERIES = {
    "tr11_training": tr11,
    "kn1_knn_vote": kn1, "kn2_knn_accuracy": kn2, "kn3_knn_metrics": kn3, "kn4_knn_fraction": kn4, "kn5_retrieval": kn5, "kn6_calibration": kn6, "kn7_leave_one_out": kn7, "kn8_recall_at_k": kn8, "kn9_prototype": kn9,
    "kn10_resemblance": kn10, "kn11_novelty_band": kn11, "kn12_ranking": kn12, "kn13_nearest_centroid": kn13, "kn14_nan_prototypes": kn14, "kn15_pooled": kn15, "kn16_ensemble": kn16, "kn17_seed_vote": kn17,
    "kn18_seed_metrics": kn18, "kn20_two_stage": kn20, "kn21_profile_call": kn21, "kn22_max_similarity": kn22, "kn23_truncation": kn23, "kn24_residue_letters": kn24,
}

_P = f"""{VEC_SQL}, pr AS (SELECT q.id AS q, t.id, t.label, t.family, list_distance(q.v, t.v) AS d FROM vec q, vec t WHERE q.part = 'query' AND t.part = 'train'),
  rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM pr)"""
_V = "vt AS (SELECT q, label, count(*) AS n, min(r) AS f FROM rk WHERE r <= 5 GROUP BY ALL), pd AS (SELECT q, arg_max(label, (n, -f)) AS pred FROM vt GROUP BY q)"
_L = f"{VEC_SQL}, lv AS (SELECT * FROM vec), ltr AS (SELECT * FROM lv WHERE part = 'train'), lo AS (SELECT a.id AS q, b.id, b.label, list_distance(a.v, b.v) AS d FROM ltr a, ltr b WHERE a.id <> b.id)"
_SEED = "sd AS (SELECT vec_id AS id, label, k - 1 AS seed, CASE WHEN embedding[k]::DOUBLE > 0 THEN 'positive' WHEN (vec_id + k) % 9 = 0 THEN NULL ELSE 'negative' END AS pred FROM embeddings, unnest(range(1, 7)) AS t(k))"
_MEAN = "(SELECT list(m ORDER BY p) FROM (SELECT p, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM vec WHERE {w}) GROUP BY p))"
ORACLE_SQL = {
    "kn1_knn_vote": f"WITH {_P}, {_V} SELECT q AS id, pred FROM pd",
    "kn2_knn_accuracy": f"WITH {_P}, {_V} SELECT round(avg((pred = label)::INT), 6) AS accuracy, count(*) AS n FROM pd JOIN vec ON vec.id = q",
    "kn3_knn_metrics": f"""WITH {_P}, {_V}, c AS (SELECT count(*) FILTER (WHERE label = 'positive' AND pred = 'positive') AS tp, count(*) FILTER (WHERE label <> 'positive' AND pred <> 'positive') AS tn, count(*) FILTER (WHERE label <> 'positive' AND pred = 'positive') AS fp,
      count(*) FILTER (WHERE label = 'positive' AND pred <> 'positive') AS fn FROM pd JOIN vec ON vec.id = q)
      SELECT tp, tn, fp, fn, round(tp / greatest(tp + fn, 1), 6) AS sensitivity, round(tn / greatest(tn + fp, 1), 6) AS specificity, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 6) AS balanced_accuracy FROM c""",
    "kn4_knn_fraction": f"WITH {_P} SELECT q AS id, round(avg((label = 'positive')::INT), 6) AS fraction, round(min(d), 6) AS nearest, CASE WHEN avg((label = 'positive')::INT) > 0.5 THEN 'positive' ELSE 'negative' END AS pred FROM rk WHERE r <= 6 GROUP BY q",
    "kn5_retrieval": f"""WITH {_P}, ltr AS (SELECT * FROM vec WHERE part = 'train'), cal AS (SELECT a.id, min(list_distance(a.v, b.v)) AS c FROM ltr a, ltr b WHERE a.id <> b.id GROUP BY a.id),
      g AS (SELECT q, avg((label = 'positive')::INT) AS f, min(d) AS n, string_agg(id::VARCHAR, ',' ORDER BY r) AS neighbours FROM rk WHERE r <= 5 GROUP BY q)
      SELECT q AS id, CASE WHEN f > 0.5 THEN 'positive' ELSE 'negative' END AS pred, round(n, 4) AS nearest, round((SELECT count(*) FILTER (WHERE c < n) / count(*) FROM cal), 4) AS percentile, neighbours FROM g""",
    "kn6_calibration": f"WITH {_L} SELECT q AS id, round(min(d), 6) AS nearest FROM lo GROUP BY q",
    "kn7_leave_one_out": f"WITH {_L}, rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM lo), {_V} SELECT q AS id, pred FROM pd",
    "kn8_recall_at_k": f"""WITH {VEC_SQL}, lv AS (SELECT * FROM vec), rk AS (SELECT a.id AS q, b.label, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM lv a, lv b WHERE a.id <> b.id AND a.label = 'positive'),
      f AS (SELECT q, min(r) FILTER (WHERE label = 'positive') AS r FROM rk WHERE r <= 20 GROUP BY q) SELECT {", ".join(f"round(avg(coalesce(r <= {k}, false)::INT), 6) AS recall{k}" for k in (1, 5, 10, 20))} FROM f""",
    "kn9_prototype": f"""WITH {VEC_SQL}, p AS (SELECT {_MEAN.format(w="part = 'train' AND label = 'positive'")} AS p), n AS (SELECT list_distance(v, p) AS c FROM vec, p WHERE part = 'train' AND label = 'negative')
      SELECT id, round(list_distance(v, p), 6) AS distance, round(100 * (SELECT count(*) FILTER (WHERE c < list_distance(v, p)) / count(*) FROM n), 4) AS percentile FROM vec, p WHERE part = 'query'""",
    "kn10_resemblance": f"WITH {_P}, p AS (SELECT {_MEAN.format(w="part = 'train'")} AS p) SELECT q AS id, round(min(d), 6) AS nearest, round(any_value(list_distance(v, p)), 6) AS to_mean FROM pr JOIN vec ON vec.id = q, p GROUP BY q",
    "kn11_novelty_band": f"WITH {_P}, n AS (SELECT q, min(d) AS n FROM pr GROUP BY q) SELECT CASE WHEN n < 0.15 THEN 'near_duplicate' WHEN n > 0.55 THEN 'too_divergent' ELSE 'novelty_band' END AS band, count(*) AS n FROM n GROUP BY 1",
    "kn12_ranking": "SELECT vec_id AS id, round(abs(embedding[1]::DOUBLE), 6) AS score, abs(embedding[1]::DOUBLE) > 0.3 AS strong FROM embeddings ORDER BY abs(embedding[1]::DOUBLE) DESC, vec_id LIMIT 25",
    "kn13_nearest_centroid": f"""WITH {VEC_SQL}, c AS (SELECT 'positive' AS label, {_MEAN.format(w="part = 'train' AND label = 'positive'")} AS c UNION ALL SELECT 'negative', {_MEAN.format(w="part = 'train' AND label = 'negative'")})
      SELECT id, arg_min(c.label, (list_distance(v, c), c.label)) AS pred FROM vec, c WHERE part = 'query' GROUP BY id""",
    "kn14_nan_prototypes": f"""WITH {VEC_SQL}, x AS (SELECT id, part, family, f, CASE WHEN v[f] >= -0.2 THEN v[f] END AS x FROM vec, unnest(range(1, 65)) AS t(f)), s AS (SELECT f, avg(x) AS m, stddev_pop(x) AS s FROM x WHERE part = 'train' GROUP BY f),
      z AS (SELECT id, part, family, f, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM x JOIN s USING (f)), p AS (SELECT family, f, avg(z) AS p FROM z WHERE part = 'train' GROUP BY ALL),
      g AS (SELECT id, p.family, sqrt(avg((z - p) * (z - p))) AS d FROM z JOIN p USING (f) WHERE part = 'query' AND z IS NOT NULL AND p IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
      SELECT id, arg_min(family, (round(d, 9), family)) AS family, round(min(d), 5) AS distance FROM g GROUP BY id""",
    "kn15_pooled": f"WITH {VEC_SQL} SELECT family, round(avg(v[1]), 6) AS x1, round(avg(v[64]), 6) AS x64, 64 AS n FROM vec GROUP BY family",
    "kn16_ensemble": f"WITH {VEC_SQL}, s AS (SELECT id // 4 AS g, p, avg(v[p]) AS m, var_pop(v[p]) AS v FROM vec, unnest(range(1, 65)) AS t(p) GROUP BY ALL) SELECT g, round(avg(m), 6) AS mean, round(avg(v), 6) AS variance FROM s GROUP BY g",
    "kn17_seed_vote": f"WITH {_SEED}, n AS (SELECT id, pred, count(*) AS n, min(seed) AS f FROM sd WHERE pred IS NOT NULL GROUP BY ALL) SELECT id, arg_max(pred, (n, -f)) AS pred FROM n GROUP BY id",
    "kn18_seed_metrics": f"WITH {_SEED}, a AS (SELECT seed, avg(((pred = 'positive') = (label % 3 = 0))::INT) AS a FROM sd WHERE pred IS NOT NULL GROUP BY seed) SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, string_agg(printf('%.4f', round(a, 4)), ' ' ORDER BY seed) AS per_seed FROM a",
    "kn20_two_stage": "SELECT vec_id AS id, abs(embedding[2]::DOUBLE * 4) > 0.5 AS arg, CASE WHEN abs(embedding[2]::DOUBLE * 4) > 0.5 THEN abs(embedding[3]::DOUBLE * 4) >= 0.5 END AS beta FROM embeddings",
    "kn21_profile_call": "SELECT vec_id AS id, coalesce(CASE WHEN vec_id % 6 <> 0 THEN embedding[4]::DOUBLE * 1000 END > 127.0, false) AS combined, coalesce(CASE WHEN vec_id % 6 <> 0 THEN embedding[4]::DOUBLE * 1000 END > 135.8, false) AS specific FROM embeddings",
    "kn22_max_similarity": f"WITH {_P}, h AS (SELECT q, max(1 / (1 + d)) AS tm FROM pr WHERE 1 / (1 + d) > 0.5 AND q % 3 <> 0 GROUP BY q) SELECT id, CASE WHEN id % 40 <> 0 THEN round(coalesce(tm, 0), 6) END AS max_tm FROM vec LEFT JOIN h ON q = id WHERE part = 'query'",
    "kn23_truncation": "SELECT doc_id, length(substr(text, 1, 1022)) AS n1022, least(length(text), 199) AS n199 FROM documents",
    "kn24_residue_letters": "WITH s AS (SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^GAVLIPFYWRSTCMNQDEKH]', 'X', 'g') AS s FROM documents) SELECT doc_id, sha256(s) AS digest, length(s) - length(replace(s, 'X', '')) AS n_x FROM s",
}
