"""Anchored templates, surface area, seeded controls and the boosted classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored, boosting, motif, spatial, workers
from ..plans.views import ATOM_SQL, SITE_SQL, STRUCT_SQL, atoms, sites, structures, vectors
from .motif import _FIT, _TRIADS, donors
from .spatial import AREA_SQL, NEAR

#: The controls' seeds.
SEEDS = {"mt17": 20260820, "mt18": 20260819}


def _parts(spark, d):
    near = spatial.with_nearest_site(atoms(spark, d).where("element <> 'C'"), sites(spark, d), "sid", "idx").where("d <= 4.5")
    return structures(spark, d), near, sites(spark, d)


def _scores(spark, d):
    st, near, si = _parts(spark, d)
    one, two = (anchored.score(st, near, si, t) for t in anchored.EXAMPLES)
    return one.union(two)


def ge14(spark, d):
    _, near, si = _parts(spark, d)
    return anchored.assignments(near, si, anchored.EXAMPLES[0]).select("sid", "site_idx", "i0", "i1", "i2")


def ge15(spark, d):
    return _scores(spark, d).select("sid", "template", "status", "n_assignments", F.round("rmsd", 4).alias("rmsd"))


def ge16(spark, d):
    return anchored.combine(_scores(spark, d)).select("sid", "supported", "n_evaluable", "n_supported", "best", F.round("rmsd", 4).alias("rmsd"))


def ge29(spark, d):
    return workers.surface_area(atoms(spark, d)).select("sid", "res_id", F.round("area", 6).alias("area"))


def mt17(spark, d):
    """The permuted donors through the search of triads and alignments; the error decides, as in the control."""
    dealt = workers.permute_coordinates(donors(spark, d), SEEDS["mt17"])
    pairs = motif.triad_pairs(motif.mixed_triads(dealt, motif.EXAMPLE), motif.histidine_triads(dealt, motif.EXAMPLE), motif.EXAMPLE)
    best = motif.alignments(pairs, motif.EXAMPLE).groupBy("sid").agg(F.min("rmsd").alias("rmsd"), F.count(F.lit(1)).alias("n_alignments"))
    out = dealt.select("sid").distinct().join(best, "sid", "left")
    return out.select("sid", F.coalesce("n_alignments", F.lit(0)).alias("n_alignments"), F.round("rmsd", 4).alias("rmsd"), F.coalesce(F.col("rmsd") <= motif.MAX_RMSD, F.lit(False)).alias("architecture_call"))


def mt18(spark, d):
    """Donors in random directions at their distances, scored again with the anchored templates."""
    st, near, si = _parts(spark, d)
    bonds = near.join(si.select("sid", "site_idx", *(F.col(c).alias(f"m{c}") for c in "xyz")), ["sid", "site_idx"])
    moved = workers.scramble_directions(bonds, SEEDS["mt18"])
    one, two = (anchored.score(st, moved, si, t) for t in anchored.EXAMPLES)
    return one.union(two).select("sid", "template", "status", "n_assignments", F.round("rmsd", 4).alias("rmsd"))


def mt20(spark, d):
    """Boosted trees on all numbers, some of them missing; predictions of the held-out."""
    v = vectors(spark, d).select("id", "part", (F.col("label") == "positive").cast("int").alias("y"), F.transform("v", lambda x: F.when(x > -0.2, x)).alias("x"))
    model = boosting.train(v.where("part = 'train'"))
    return boosting.predict(v.where("part = 'query'"), model).select("id", "pred")


QUERIES = {"ge14_assignments": ge14, "ge15_anchored_score": ge15, "ge16_combined_templates": ge16, "ge29_surface_area": ge29, "mt17_permutation_control": mt17, "mt18_direction_control": mt18, "mt20_boosted_trees": mt20}

_DON = "don AS (SELECT * FROM near WHERE rn = 1 AND d <= 4.5 AND element <> 'C')"
_PARTS = f"{ATOM_SQL}, {SITE_SQL}, {STRUCT_SQL}, {NEAR}, {_DON}"
_ASG = "asg AS (SELECT s.sid, s.site_idx, n.idx AS i0, o.idx AS i1, c.idx AS i2, [s.x, n.x, o.x, c.x] AS px, [s.y, n.y, o.y, c.y] AS py, [s.z, n.z, o.z, c.z] AS pz FROM site s JOIN don n ON n.sid = s.sid AND n.site_idx = s.site_idx AND n.element = 'N' JOIN don o ON o.sid = s.sid AND o.site_idx = s.site_idx AND o.element = 'O' JOIN don c ON c.sid = s.sid AND c.site_idx = s.site_idx AND c.element = 'S')"
_TPL = "tpl AS (SELECT * FROM (VALUES ('short', [0.0, 2.0, 0.0, 0.0]::DOUBLE[], [0.0, 0.0, 2.0, 0.0]::DOUBLE[], [0.0, 0.0, 0.0, 2.3]::DOUBLE[]), ('wide', [0.0, 3.0, 0.0, -2.0]::DOUBLE[], [0.0, 0.0, 3.0, 0.0]::DOUBLE[], [0.0, 0.0, 0.0, 2.5]::DOUBLE[])) AS t(name, ax, ay, az))"
_U = "u AS (SELECT asg.*, name, list_avg(px) AS gx, list_avg(py) AS gy, list_avg(pz) AS gz, list_transform(ax, lambda v: v - list_avg(ax)) AS tx, list_transform(ay, lambda v: v - list_avg(ay)) AS ty, list_transform(az, lambda v: v - list_avg(az)) AS tz FROM asg, tpl)"
_TAIL = _FIT[_FIT.index("cov AS (") :].replace("sid, oi, si, ni, perm, i1, i2, i3, dev", "sid, name, site_idx, i0, i1, i2").replace("/ 6, 0)) AS rmsd", "/ 4, 0)) AS rmsd")
_SC = f"WITH {_PARTS}, {_ASG}, {_TPL}, {_U}, {_TAIL}, b AS (SELECT sid, name, min(rmsd) AS rmsd, count(*) AS n FROM fit GROUP BY ALL), sc AS (SELECT t.sid, tpl.name AS template, CASE WHEN h.sid IS NULL THEN 'unavailable' WHEN n IS NULL THEN 'not_applicable' WHEN rmsd <= 1.25 THEN 'supported' ELSE 'not_supported' END AS status, coalesce(n, 0) AS n_assignments, rmsd FROM structure t CROSS JOIN tpl LEFT JOIN (SELECT DISTINCT sid FROM site) h USING (sid) LEFT JOIN b ON b.sid = t.sid AND b.name = tpl.name)"
_UNI = lambda seed, stream: f"(('0x' || substr(sha256('{seed}{stream}:' || sid || ':' || idx), 1, 8))::BIGINT / 4294967296.0)"
_PERMUTED = f"""raw AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY idx) AS k, row_number() OVER (PARTITION BY sid ORDER BY {_UNI(SEEDS['mt17'], 'p')}, idx) AS u FROM base),
atom AS (SELECT o.sid, o.idx, o.role, n.x, n.y, n.z FROM raw o JOIN raw n ON n.sid = o.sid AND n.u = o.k)"""
_LEN = "sqrt((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y) + (n.z - s.z) * (n.z - s.z))"
_MOVED = f"""dn AS (SELECT n.sid, n.idx, n.site_idx, n.element, s.x AS mx, s.y AS my, s.z AS mz, {_LEN} AS l, 1 - 2 * {_UNI(SEEDS['mt18'], 'z').replace('sid', 'n.sid').replace('idx', 'n.idx')} AS hz, 2 * pi() * {_UNI(SEEDS['mt18'], 't').replace('sid', 'n.sid').replace('idx', 'n.idx')} AS t
  FROM near n JOIN site s ON s.sid = n.sid AND s.site_idx = n.site_idx WHERE n.rn = 1 AND n.d <= 4.5 AND n.element <> 'C'),
don AS (SELECT sid, idx, site_idx, element, mx + l * sqrt(greatest(0.0, 1 - hz * hz)) * cos(t) AS x, my + l * sqrt(greatest(0.0, 1 - hz * hz)) * sin(t) AS y, mz + l * hz AS z FROM dn)"""
ORACLE_SQL = {
    "ge14_assignments": f"WITH {_PARTS}, {_ASG} SELECT sid, site_idx, i0, i1, i2 FROM asg",
    "ge15_anchored_score": f"{_SC} SELECT sid, template, status, n_assignments, round(rmsd, 4) AS rmsd FROM sc",
    "ge16_combined_templates": f"""{_SC} SELECT sid, bool_or(status = 'supported') AS supported, count(rmsd) AS n_evaluable, count(*) FILTER (WHERE status = 'supported') AS n_supported,
      coalesce(arg_min(template, (rmsd, template)) FILTER (WHERE status = 'supported'), arg_min(template, (rmsd, template)) FILTER (WHERE rmsd IS NOT NULL)) AS best, round(coalesce(min(rmsd) FILTER (WHERE status = 'supported'), min(rmsd)), 4) AS rmsd FROM sc GROUP BY sid""",
    "ge29_surface_area": f"WITH {ATOM_SQL}, {AREA_SQL} SELECT sid, res_id, round(area, 6) AS area FROM area",
    "mt17_permutation_control": f"""WITH {ATOM_SQL.replace('atom AS', 'base AS', 1)}, {_PERMUTED}, {_TRIADS}, {_FIT}, best AS (SELECT sid, min(rmsd) AS rmsd, count(*) AS n FROM fit GROUP BY sid)
      SELECT sid, coalesce(n, 0) AS n_alignments, round(rmsd, 4) AS rmsd, coalesce(rmsd <= 1.25, false) AS architecture_call FROM (SELECT DISTINCT sid FROM atom) LEFT JOIN best USING (sid)""",
    "mt18_direction_control": _SC.replace(_DON, _MOVED) + " SELECT sid, template, status, n_assignments, round(rmsd, 4) AS rmsd FROM sc",
}
