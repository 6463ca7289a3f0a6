"""Motif queries on the stand-in atoms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import distance, moved, point, with_superposition
from ..operators import motif
from ..plans.views import ATOM_SQL, STRUCT_SQL, atoms, structures

T = motif.EXAMPLE
_SIDE = 3.4641016151377544
#: Gates of the stand-in atoms, which lie closer together than those of a protein: share of clashes, of contacts.
CLASH, CONTACT = 0.50, 0.50
LEVELS = (0.25, 0.5, 0.75)


def donors(spark, d):
    return atoms(spark, d).select("sid", "idx", F.col("idx").alias("res"), "role", "x", "y", "z")


_D = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"
_TRIADS = f"""
m AS (SELECT o.sid, o.idx AS oi, s.idx AS si, n.idx AS ni, o.x AS ox, o.y AS oy, o.z AS oz, s.x AS sx, s.y AS sy, s.z AS sz, n.x AS nx, n.y AS ny, n.z AS nz,
    greatest(abs({_D("o", "s")} - 4), abs({_D("o", "n")} - 4), abs({_D("s", "n")} - 4)) AS odev
  FROM atom o JOIN atom s ON o.sid = s.sid JOIN atom n ON n.sid = o.sid
  WHERE o.role = 'ASP_O' AND s.role = 'CYS_S' AND n.role = 'HIS_N' AND abs({_D("o", "s")} - 4) <= 0.75 AND abs({_D("o", "n")} - 4) <= 0.75 AND abs({_D("s", "n")} - 4) <= 0.75),
h AS (SELECT a.sid, a.idx AS ai, b.idx AS bi, c.idx AS ci, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
    greatest(abs({_D("a", "b")} - 4), abs({_D("a", "c")} - 4), abs({_D("b", "c")} - 4)) AS adev
  FROM atom a JOIN atom b ON a.sid = b.sid AND a.idx < b.idx JOIN atom c ON c.sid = a.sid AND b.idx < c.idx
  WHERE a.role = 'HIS_N' AND b.role = 'HIS_N' AND c.role = 'HIS_N' AND abs({_D("a", "b")} - 4) <= 0.75 AND abs({_D("a", "c")} - 4) <= 0.75 AND abs({_D("b", "c")} - 4) <= 0.75),
p AS (SELECT *, greatest(odev, adev) AS dev FROM m JOIN h USING (sid) WHERE ni NOT IN (ai, bi, ci)
  AND abs(sqrt(pow((ox + sx + nx) / 3 - (ax + bx + cx) / 3, 2) + pow((oy + sy + ny) / 3 - (ay + "by" + cy) / 3, 2) + pow((oz + sz + nz) / 3 - (az + bz + cz) / 3, 2)) - 5) <= 2.5)"""

_FIT = f"""
q AS (SELECT sid, oi, si, ni, perm, i1, i2, i3, dev,
    [ox, sx, nx, x1, x2, x3] AS px, [oy, sy, ny, y1, y2, y3] AS py, [oz, sz, nz, z1, z2, z3] AS pz FROM (
  SELECT *, [ai, bi, ci][o1] AS i1, [ai, bi, ci][o2] AS i2, [ai, bi, ci][o3] AS i3, [ax, bx, cx][o1] AS x1, [ax, bx, cx][o2] AS x2, [ax, bx, cx][o3] AS x3,
    [ay, "by", cy][o1] AS y1, [ay, "by", cy][o2] AS y2, [ay, "by", cy][o3] AS y3, [az, bz, cz][o1] AS z1, [az, bz, cz][o2] AS z2, [az, bz, cz][o3] AS z3
  FROM p, (VALUES (0, 1, 2, 3), (1, 1, 3, 2), (2, 2, 1, 3), (3, 2, 3, 1), (4, 3, 1, 2), (5, 3, 2, 1)) AS o(perm, o1, o2, o3))),
u AS (SELECT *, list_avg(px) AS gx, list_avg(py) AS gy, list_avg(pz) AS gz,
  [0.0 - 2, 4.0 - 2, 0.0, 0.0 - 2, 4.0 - 2, 0.0]::DOUBLE[] AS tx, [0 - {_SIDE} / 3, 0 - {_SIDE} / 3, {_SIDE} * 2 / 3, 0 - {_SIDE} / 3, 0 - {_SIDE} / 3, {_SIDE} * 2 / 3]::DOUBLE[] AS ty,
  [-2.5, -2.5, -2.5, 2.5, 2.5, 2.5]::DOUBLE[] AS tz FROM q),
cov AS (SELECT sid, oi, si, ni, perm, i1, i2, i3, dev, gx, gy, gz, {", ".join(f"list_dot_product(list_transform(p{a}, lambda v: v - g{a}), t{b}) AS h{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz"))},
  {" + ".join(f"list_sum(list_transform(p{a}, lambda v: (v - g{a}) * (v - g{a})))" for a in "xyz")} + list_dot_product(tx, tx) + list_dot_product(ty, ty) + list_dot_product(tz, tz) AS e FROM u),
mm AS (SELECT *, {", ".join(f"h0{i} * h0{j} + h1{i} * h1{j} + h2{i} * h2{j} AS m{i}{j}" for i in range(3) for j in range(i, 3))},
  h00 * (h11 * h22 - h12 * h21) - h01 * (h10 * h22 - h12 * h20) + h02 * (h10 * h21 - h11 * h20) AS det FROM cov),
tr AS (SELECT *, (m00 + m11 + m22) / 3 AS q0 FROM mm),
ps AS (SELECT *, sqrt((pow(m00 - q0, 2) + pow(m11 - q0, 2) + pow(m22 - q0, 2) + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) AS p0 FROM tr),
rs AS (SELECT *, CASE WHEN p0 > 0 THEN greatest(-1.0, least(1.0, ((m00 - q0) * ((m11 - q0) * (m22 - q0) - m12 * m12) - m01 * (m01 * (m22 - q0) - m12 * m02) + m02 * (m01 * m12 - (m11 - q0) * m02)) / (p0 * p0 * p0) / 2)) ELSE 1.0 END AS r0 FROM ps),
ev AS (SELECT *, q0 + 2 * p0 * cos(acos(r0) / 3) AS e1, q0 + 2 * p0 * cos(acos(r0) / 3 + 2.0943951023931953) AS e3 FROM rs),
fit AS (SELECT *, sqrt(greatest((e - 2 * (sqrt(greatest(e1, 0)) + sqrt(greatest(3 * q0 - e1 - e3, 0)) + CASE WHEN det < 0 THEN -1 ELSE 1 END * sqrt(greatest(e3, 0)))) / 6, 0)) AS rmsd FROM ev)"""

#: The motion in closed form: with C = X'Y and the signed square root K of CC' (by its invariants), R = C / K.
_ROT = [[" + ".join(f"v{i}{k} * h{j}{k}" for k in range(3)) for j in range(3)] for i in range(3)]
_SYM = lambda i, j: f"m{min(i, j)}{max(i, j)}"
_AT = lambda p: [f"g{c} + " + " + ".join(f"({v}) * r{i}{j}" for i, v in enumerate(p)) for j, c in enumerate("xyz")]
_TURN = f"""
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rmsd, oi, si, ni, i1, i2, i3, perm) AS place FROM fit) WHERE place = 1 OR rmsd <= 1.25),
sg AS (SELECT *, sqrt(greatest(e1, 0)) AS s1, sqrt(greatest(3 * q0 - e1 - e3, 0)) AS s2, sign(det) * sqrt(greatest(e3, 0)) AS s3 FROM pick),
iv AS (SELECT *, s1 + s2 + s3 AS a1, s1 * s2 + s2 * s3 + s3 * s1 AS a2, s1 * s2 * s3 AS a3 FROM sg),
sr AS (SELECT *, {", ".join(f"((a1 * a1 - a2) * {_SYM(i, j)} - ({' + '.join(f'{_SYM(i, k)} * {_SYM(k, j)}' for k in range(3))}){' + a1 * a3' if i == j else ''}) / (a1 * a2 - a3) AS k{i}{j}" for i in range(3) for j in range(3))} FROM iv),
kv AS (SELECT *, {", ".join(f"({_SYM(i, j)} - a1 * k{i}{j}{' + a2' if i == j else ''}) / a3 AS v{i}{j}" for i in range(3) for j in range(3))} FROM sr),
turn AS (SELECT *, {", ".join(f"{_ROT[i][j]} AS r{i}{j}" for i in range(3) for j in range(3))} FROM kv)"""
_OFF = lambda p: [f"{v} - {c}" for v, c in zip(p, ("2.0", f"{_SIDE} / 3", "2.5"), strict=True)]
_POSE = f"""
lig AS (SELECT sid, place, lig, {", ".join(f"{e} AS {c}" for e, c in zip(_AT(["lx - 2.0", f"ly - {_SIDE} / 3", "lz - 2.5"]), "xyz", strict=True))}
  FROM turn, (VALUES {", ".join(str((k, *p)) for k, p in enumerate(T.ligand))}) AS l(lig, lx, ly, lz)),
nr AS (SELECT lig.sid, place, lig, min({_D("lig", "b")}) AS d FROM lig JOIN atom b ON b.sid = lig.sid GROUP BY ALL),
pose AS (SELECT sid, place, avg((d < 1.5)::INT) AS clash_share, avg((d <= 4.5)::INT) AS contact_share, min(d) AS min_distance FROM nr GROUP BY ALL),
posed AS (SELECT *, rmsd <= 1.25 AND clash_share <= {CLASH} AND contact_share >= {CONTACT} AS passes FROM turn JOIN pose USING (sid, place))"""


def ge3(spark, d):
    return motif.mixed_triads(donors(spark, d), T).select("sid", "oi", "si", "ni")


def ge4(spark, d):
    return motif.histidine_triads(donors(spark, d), T).select("sid", "ai", "bi", "ci")


def ge6(spark, d):
    a = donors(spark, d)
    return motif.triad_pairs(motif.mixed_triads(a, T), motif.histidine_triads(a, T), T).groupBy("sid").agg(F.count(F.lit(1)).alias("n_pairs"))


def ge8(spark, d):
    a = donors(spark, d)
    fits = motif.alignments(motif.triad_pairs(motif.mixed_triads(a, T), motif.histidine_triads(a, T), T), T)
    return fits.groupBy("sid").agg(F.count(F.lit(1)).alias("n_alignments"), F.round(F.min("rmsd"), 4).alias("best"), F.round(F.avg("rmsd"), 4).alias("mean"))


def ge8_motion(spark, d):
    """Rotation and translation of the best alignment of each structure, as the template's metals after them."""
    a = donors(spark, d)
    fits = motif.alignments(motif.triad_pairs(motif.mixed_triads(a, T), motif.histidine_triads(a, T), T), T)
    best = fits.groupBy("sid").agg(F.min_by("target", F.struct(*motif.ORDER)).alias("target"), F.min("rmsd").alias("rmsd"))
    r, t = F.col("rotation"), F.col("translation")
    placed = with_superposition(best.where(f"rmsd <= {motif.MAX_RMSD}"), [*T.first, *T.second])
    metal = [moved(tuple(F.lit(v) for v in p), r, t) for p in T.metals]
    return placed.select("sid", *(F.round(v, 3).alias(f"{c}{k}") for k, p in enumerate(metal) for c, v in zip("xyz", p, strict=True)))


def ge12(spark, d):
    found = motif.search(donors(spark, d), max_clash=CLASH, min_contact=CONTACT)
    real = ("rmsd", "clash_share", "contact_share", "min_distance")
    return found.select("sid", "n_donors", "n_mixed", "n_his", "n_alignments", *(F.round(c, 4).alias(c) for c in real), "architecture_call", "full_pose_call", "status")


def ge2(spark, d):
    a = donors(spark, d)
    pick = lambda k: a.where(F.col("idx") == k).select("sid", *(F.col(c).alias(f"p{k}{c}") for c in "xyz"))
    j = pick(0).join(pick(1), "sid").join(pick(2), "sid")
    return j.select("sid", *(F.round(distance(point(f"p{p}"), point(f"p{q}")), 6).alias(f"d{p}{q}") for p, q in ((0, 1), (0, 2), (1, 2))))


def mt15(spark, d):
    return motif.inventory(donors(spark, d))


def mt16(spark, d):
    a = donors(spark, d)
    have = lambda df, name: df.select("sid").distinct().withColumn(name, F.lit(True))
    j = a.select("sid").distinct().join(have(motif.mixed_triads(a, T), "m"), "sid", "left").join(have(motif.histidine_triads(a, T), "h"), "sid", "left")
    return j.select("sid", (F.col("m").isNotNull() & F.col("h").isNotNull()).alias("both_sites"))


def fi2(spark, d):
    return motif.donor_roles(atoms(spark, d)).groupBy("sid", "role").agg(F.count(F.lit(1)).alias("n"))


def _swept(spark, d):
    """sid, truth, panel, and the least tolerance at which it is called: B1 against negatives on a test panel and
    on all structures, and on the structures of the last tier as the external set (with the other subclasses)."""
    st = structures(spark, d).withColumn("truth", F.coalesce(F.col("subclass") == "B1", F.lit(False)))
    plain = F.col("truth") | (F.col("label") != "positive")
    panels = F.array(F.when(plain & (F.col("sid") % 2 == 0), "internal_panel"), F.when(plain, "internal_all"), F.when((F.col("tier") == 4) & F.col("subclass").isNotNull(), "external"))
    rows = st.select("sid", "truth", F.explode(panels).alias("panel")).where("panel is not null")
    least = motif.least_tolerance(donors(spark, d), T, max_clash=CLASH, min_contact=CONTACT)
    return rows.join(least.withColumnRenamed("tolerance", "least"), "sid", "left").withColumn("tolerance", F.explode(F.array(*(F.lit(v) for v in LEVELS)))).withColumn("called", F.coalesce(F.col("least") <= F.col("tolerance"), F.lit(False)))


def mt13(spark, d):
    """Confusion by panel at each tolerance of pair distances."""
    n = lambda truth, called: F.count_if((F.col("truth") == truth) & (F.col("called") == called))
    return _swept(spark, d).groupBy("panel", "tolerance").agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, True).alias("fp"), n(False, False).alias("tn"))


def mt13_ids(spark, d):
    """The external structures that are called, at each tolerance."""
    return _swept(spark, d).where("panel = 'external' and called").select("tolerance", "sid")


def ge13(spark, d):
    """Modified-ligand flags: a call, and the call without modified cysteines."""
    a = atoms(spark, d).select("sid", "idx", F.col("idx").alias("res"), "role", "x", "y", "z", ((F.col("sid") + F.col("idx")) % 4 == 0).alias("modified"))
    fits = motif.alignments(motif.triad_pairs(motif.mixed_triads(a, T), motif.histidine_triads(a, T), T), T)
    best = fits.groupBy("sid").agg(F.min_by("smod", F.struct(F.round("rmsd", 9), "oi", "si", "ni", "ai", "bi", "ci")).alias("modified"), F.min("rmsd").alias("rmsd"))
    return best.select("sid", "modified", (F.col("rmsd") <= 2).alias("call"), ((F.col("rmsd") <= 2) & ~F.col("modified")).alias("native_call"))


QUERIES = {
    "fi2_donor_roles": fi2, "ge2_fingerprint": ge2, "ge3_mixed_triads": ge3, "ge4_histidine_triads": ge4, "ge6_triad_pairs": ge6, "ge7_ge8_superposition": ge8,
    "ge8_motion": ge8_motion, "ge12_six_donor_search": ge12, "ge13_modified_flags": ge13, "mt13_threshold_sweep": mt13, "mt13_external_ids": mt13_ids, "mt15_donor_inventory": mt15, "mt16_both_sites": mt16,
}
_COUNTS = """
base AS (SELECT sid, count(*) AS n_donors FROM atom GROUP BY sid), nm AS (SELECT sid, count(*) AS n_mixed FROM m GROUP BY sid), nh AS (SELECT sid, count(*) AS n_his FROM h GROUP BY sid),
na AS (SELECT sid, count(*) AS n_alignments FROM fit GROUP BY sid),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY NOT passes, rmsd, oi, si, ni, i1, i2, i3, perm) AS nth FROM posed) WHERE nth = 1)"""
_SWEPT = f"""
st AS (SELECT sid, label, subclass, tier, coalesce(subclass = 'B1', false) AS truth FROM structure),
pn AS (SELECT sid, truth, 'internal_panel' AS panel FROM st WHERE (truth OR label <> 'positive') AND sid % 2 = 0 UNION ALL SELECT sid, truth, 'internal_all' FROM st WHERE truth OR label <> 'positive'
  UNION ALL SELECT sid, truth, 'external' FROM st WHERE tier = 4 AND subclass IS NOT NULL),
ls AS (SELECT sid, min(dev) AS least FROM posed WHERE passes GROUP BY sid),
sw AS (SELECT panel, sid, truth, tolerance::DOUBLE AS tolerance, coalesce(least <= tolerance, false) AS called FROM pn LEFT JOIN ls USING (sid), (VALUES {", ".join(f"({v})" for v in LEVELS)}) AS t(tolerance))"""
ORACLE_SQL = {
    "fi2_donor_roles": f"WITH {ATOM_SQL} SELECT sid, role, count(*) AS n FROM atom WHERE atom_name <> 'CA' GROUP BY ALL",
    "ge2_fingerprint": f"WITH {ATOM_SQL} SELECT a.sid, round({_D('a', 'b')}, 6) AS d01, round({_D('a', 'c')}, 6) AS d02, round({_D('b', 'c')}, 6) AS d12 FROM atom a JOIN atom b USING (sid) JOIN atom c USING (sid) WHERE a.idx = 0 AND b.idx = 1 AND c.idx = 2",
    "ge3_mixed_triads": f"WITH {ATOM_SQL}, {_TRIADS} SELECT sid, oi, si, ni FROM m",
    "ge4_histidine_triads": f"WITH {ATOM_SQL}, {_TRIADS} SELECT sid, ai, bi, ci FROM h",
    "ge6_triad_pairs": f"WITH {ATOM_SQL}, {_TRIADS} SELECT sid, count(*) AS n_pairs FROM p GROUP BY sid",
    "ge7_ge8_superposition": f"WITH {ATOM_SQL}, {_TRIADS}, {_FIT} SELECT sid, count(*) AS n_alignments, round(min(rmsd), 4) AS best, round(avg(rmsd), 4) AS mean FROM fit GROUP BY sid",
    "ge8_motion": f"""WITH {ATOM_SQL}, {_TRIADS}, {_FIT}, {_TURN}
      SELECT sid, {", ".join(f"round({e}, 3) AS {c}{k}" for k, p in enumerate(T.metals) for c, e in zip("xyz", _AT(_OFF(p)), strict=True))} FROM turn WHERE place = 1 AND rmsd <= 1.25""",
    "ge12_six_donor_search": f"""WITH {ATOM_SQL}, {_TRIADS}, {_FIT}, {_TURN}, {_POSE}, {_COUNTS}
      SELECT sid, n_donors, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_his, 0) AS n_his, coalesce(n_alignments, 0) AS n_alignments, round(rmsd, 4) AS rmsd, round(clash_share, 4) AS clash_share,
        round(contact_share, 4) AS contact_share, round(min_distance, 4) AS min_distance, coalesce(rmsd <= 1.25, false) AS architecture_call, coalesce(passes, false) AS full_pose_call,
        CASE WHEN passes THEN 'supported' ELSE 'not_supported' END AS status
      FROM base LEFT JOIN nm USING (sid) LEFT JOIN nh USING (sid) LEFT JOIN na USING (sid) LEFT JOIN best USING (sid)""",
    "ge13_modified_flags": f"""WITH {ATOM_SQL}, {_TRIADS}, {_FIT}, b AS (SELECT sid, min(rmsd) AS rmsd, arg_min(si, (round(rmsd, 9), oi, si, ni, i1, i2, i3)) AS si FROM fit GROUP BY sid)
      SELECT sid, (sid + si) % 4 = 0 AS modified, rmsd <= 2 AS call, rmsd <= 2 AND (sid + si) % 4 <> 0 AS native_call FROM b""",
    "mt13_threshold_sweep": f"""WITH {ATOM_SQL}, {STRUCT_SQL}, {_TRIADS}, {_FIT}, {_TURN}, {_POSE}, {_SWEPT}
      SELECT panel, tolerance, count(*) FILTER (WHERE truth AND called) AS tp, count(*) FILTER (WHERE truth AND NOT called) AS fn, count(*) FILTER (WHERE NOT truth AND called) AS fp,
        count(*) FILTER (WHERE NOT truth AND NOT called) AS tn FROM sw GROUP BY ALL""",
    "mt13_external_ids": f"WITH {ATOM_SQL}, {STRUCT_SQL}, {_TRIADS}, {_FIT}, {_TURN}, {_POSE}, {_SWEPT} SELECT tolerance, sid FROM sw WHERE panel = 'external' AND called",
    "mt15_donor_inventory": f"""WITH {ATOM_SQL} SELECT *, n_his_res >= 4 AND n_asp_res >= 1 AND n_cys_res >= 1 AS complete FROM (
      SELECT sid, count(DISTINCT CASE WHEN role = 'HIS_N' THEN idx END) AS n_his_res, count(DISTINCT CASE WHEN role = 'ASP_O' THEN idx END) AS n_asp_res, count(DISTINCT CASE WHEN role = 'CYS_S' THEN idx END) AS n_cys_res
      FROM atom GROUP BY sid)""",
    "mt16_both_sites": f"WITH {ATOM_SQL}, {_TRIADS} SELECT sid, sid IN (SELECT sid FROM m) AND sid IN (SELECT sid FROM h) AS both_sites FROM (SELECT DISTINCT sid FROM atom)",
}
