"""Spatial queries on the stand-in atoms and sites, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import angle_degrees, bond_valence, distance, distance_n, point
from ..operators import encoder, spatial, workers
from ..operators.graph import _checkpoint
from ..operators.ordered import upper_median
from ..operators.motif import DONORS
from ..plans.views import ATOM_SQL, SITE_SQL, STRUCT_SQL, atoms, sites, structures, table

AS = f"{ATOM_SQL}, {SITE_SQL}"
D = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"
NEAR = f"near AS (SELECT a.*, s.site_idx, s.probability, {D('a', 's')} AS d, row_number() OVER (PARTITION BY a.sid, a.idx ORDER BY {D('a', 's')}, s.site_idx) AS rn FROM atom a JOIN site s USING (sid))"
CENTRE = """res AS (SELECT sid, res_id, CASE WHEN n = 1 THEN cx ELSE mx END AS x, CASE WHEN n = 1 THEN cy ELSE my END AS y, CASE WHEN n = 1 THEN cz ELSE mz END AS z FROM (
  SELECT sid, res_id, count(*) FILTER (WHERE atom_name = 'CA') AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
    arg_min(x, idx) FILTER (WHERE atom_name = 'CA') AS cx, arg_min(y, idx) FILTER (WHERE atom_name = 'CA') AS cy, arg_min(z, idx) FILTER (WHERE atom_name = 'CA') AS cz FROM atom GROUP BY ALL))"""


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def ge1(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("v"))
    return a.join(b, "a").select("a", F.round(distance_n("u", "v"), 6).alias("distance"))


def ge5(spark, d):
    return spatial.with_nearest_site(atoms(spark, d), sites(spark, d), "sid", "idx").select("sid", "idx", "site_idx", *r6("d"))


def fi3(spark, d):
    return spatial.canonical_donors(atoms(spark, d), sites(spark, d), DONORS, 3.5).select("sid", "idx", "element", "site_idx", *r6("d"))


def fi4(spark, d):
    return atoms(spark, d).where(~F.upper("element").isin("H", "D")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))


def _ligand(spark, d):
    return atoms(spark, d).where("idx >= 15").withColumnRenamed("idx", "lig")


def ge10(spark, d):
    pose = spatial.pose_metrics(_ligand(spark, d), atoms(spark, d).where("idx < 15"))
    return pose.select("sid", *r6("clash_share", "contact_share", "min_distance"), "n_heavy")


def ge11(spark, d):
    lig = _ligand(spark, d)
    pose = spatial.pose_metrics(lig, atoms(spark, d).where("idx < 15")).join(spatial.metal_metrics(lig, sites(spark, d)), "sid", "left")
    return pose.select("sid", *r6("clash_share", "contact_share", "min_distance"), "n_heavy", *r6("min_metal", "min_hetero_metal"))


def ge17(spark, d):
    return spatial.sulfur_rule(structures(spark, d), atoms(spark, d), sites(spark, d), 3.0).select("sid", "status", *r6("distance", "probability"))


def ge18(spark, d):
    """Combined status from the full architecture's call (here: label), the sulfur rule and the site count."""
    s = structures(spark, d).select("sid", ((F.col("label") == "positive") & (F.col("sid") % 2 == 0)).alias("full"))
    n = sites(spark, d).groupBy("sid").agg(F.count(F.lit(1)).alias("n_sites"))
    j = s.join(spatial.sulfur_rule(structures(spark, d), atoms(spark, d), sites(spark, d), 3.0), "sid").join(n, "sid", "left").fillna(0, ["n_sites"])
    status = F.when(F.col("full"), "supported").when(F.col("status") == "supported", "partial_support").when(F.col("n_sites") == 0, "unavailable").when(F.col("n_sites") != 2, "not_applicable").otherwise("not_supported")
    return j.select("sid", status.alias("combined"))


def ge19(spark, d):
    probes = atoms(spark, d).where("idx >= 15").select("sid", F.col("idx").alias("site_idx"), (F.col("b_factor") / 400).alias("probability"), *"xyz")
    return spatial.select_sites(probes)


def ge20(spark, d):
    """Sites where the top probability reaches 0.5, else the cavity centroid, else an error status."""
    top = sites(spark, d).groupBy("sid").agg(F.max("probability").alias("p"))
    cavity = atoms(spark, d).where("sid % 2 = 0").groupBy("sid").agg(F.avg("x").alias("cx"))
    j = structures(spark, d).select("sid").join(top, "sid", "left").join(cavity, "sid", "left")
    return j.select("sid", F.when(F.col("p") >= 0.5, "metal").when(F.col("cx").isNotNull(), "cavity").otherwise("error").alias("source"))


def ge21(spark, d):
    return spatial.extract_pocket(atoms(spark, d), sites(spark, d), 6.0).groupBy("sid").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("res_id").alias("n_residues"), F.count_if("is_sidechain").alias("n_sidechain"))


def ge22(spark, d):
    return spatial.centroids(atoms(spark, d)).select("sid", "res_id", *r6(*"xyz"))


def ge23(spark, d):
    ca = spatial.centroids(atoms(spark, d), lone=False)
    return spatial.residues_within(ca, sites(spark, d), 5.0).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


def ge24(spark, d):
    return spatial.canonical_donors(atoms(spark, d), sites(spark, d), DONORS, 2.8).select("sid", "res_id").distinct()


def ge25(spark, d):
    return spatial.radius_graph(spatial.centroids(atoms(spark, d)), 4.0).select("sid", "src", "dst", *r6("distance"), "is_adjacent")


def _backbone(spark, d):
    a = atoms(spark, d)
    pick = lambda k, p: a.where(F.col("idx") % 3 == k).select("sid", F.floor(F.col("idx") / 3).cast("int").alias("res_id"), *(F.col(c).alias(f"{p}{c}") for c in "xyz"))
    return pick(0, "n").join(pick(1, "a"), ["sid", "res_id"]).join(pick(2, "c"), ["sid", "res_id"]).where("(sid + res_id) % 11 <> 0")


def ge26(spark, d):
    return spatial.backbone_torsions(_backbone(spark, d)).select("sid", "res_id", *r6("sin_phi", "cos_phi", "sin_psi", "cos_psi"))


def ge27(spark, d):
    """Least distance of a residue's ligand atoms to a metal and the bond flag; zeros if it cannot."""
    ok = F.lit(False)
    for res, names in DONORS.items():
        ok = ok | ((F.col("res_name") == res) & F.col("atom_name").isin(*names))
    near = spatial.with_nearest_site(atoms(spark, d).where(ok), sites(spark, d), "sid", "idx").groupBy("sid", "res_id").agg(F.min("d").alias("m"))
    j = atoms(spark, d).select("sid", "res_id").distinct().join(near, ["sid", "res_id"], "left")
    return j.select("sid", "res_id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("metal_distance"), F.coalesce(F.col("m") <= 2.8, F.lit(False)).cast("int").alias("bonded"))


def ge28(spark, d):
    c = spatial.centroids(atoms(spark, d)).withColumn("idx", F.col("res_id"))
    near = spatial.with_nearest_site(c, sites(spark, d), "sid", "idx").select("sid", "res_id", "d")
    one = spatial.shell(F.col("d"))
    return c.select("sid", "res_id").join(near, ["sid", "res_id"], "left").groupBy("sid").agg(*(F.sum(one[k]).alias(f"shell{k}") for k in range(3)))


def _nodes(spark, d):
    a = atoms(spark, d)
    e = a.select("sid", "res_id").distinct().join(table(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), "embedding"), "sid")
    e = e.where("res_id % 9 <> 8").select("sid", "res_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("res_id") + 1)).alias("v"))
    return spatial.node_features(a, sites(spark, d), _backbone(spark, d), e, workers.surface_area(a), DONORS)


def ge31(spark, d):
    """The width of the feature vectors, and a sum in which each place has its own weight."""
    total = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return _nodes(spark, d).select("sid", "res_id", F.size("features").alias("width"), F.round(total, 4).alias("total"))


def residue_graphs(spark, d):
    """Nodes with all their features, and the edges of GE25."""
    return _nodes(spark, d), spatial.radius_graph(spatial.centroids(atoms(spark, d)), 4.0)


def tr10(spark, d):
    """Structures as unit vectors: two layers with seeded weights over their residue graphs."""
    nodes, edges = residue_graphs(spark, d)
    nodes = _checkpoint(nodes)
    w = encoder.weights(nodes.agg(F.max(F.size("features"))).first()[0] or 0)
    return encoder.encode(nodes, edges, w).select("sid", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


def ge32(spark, d):
    a = atoms(spark, d)
    pick = lambda k: a.where(F.col("idx") == k).select("sid", *(F.col(c).alias(f"p{k}{c}") for c in "xyz"))
    j = pick(0).join(pick(1), "sid").join(pick(2), "sid")
    return j.select("sid", F.round(angle_degrees(point("p0"), point("p1"), point("p2")), 5).alias("angle"))


def ge34(spark, d):
    don = spatial.canonical_donors(atoms(spark, d), sites(spark, d), DONORS, 4.0)
    r0 = F.coalesce(*(F.when(F.col("element") == e, r) for e, r in spatial.VALENCE_RADII.items()))
    return don.groupBy("sid").agg(F.round(F.sum(bond_valence(F.col("d"), r0)), 6).alias("valence"))


def ge35(spark, d):
    a = atoms(spark, d)
    f = spatial.coordination_fingerprint(structures(spark, d), a, sites(spark, d), DONORS, workers.surface_area(a), 5.0)
    return f.select("sid", *(F.round(c, 4).alias(c) for c in f.columns[1:]))


def ge36(spark, d):
    """Zinc coordination: N, O, S atoms nearer than 2.5, the two scores and the verdict."""
    near = spatial.with_nearest_site(atoms(spark, d).where("element in ('N', 'O', 'S')"), sites(spark, d), "sid", "idx").where("d < 2.5")
    n = near.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("d") - 2.1)).alias("off"))
    j = structures(spark, d).select("sid").join(n, "sid", "left").fillna(0, ["n"])
    cn = F.when(F.col("n").between(3, 5), 1.0).when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.25 * F.abs(F.col("n") - 4)))
    dist = F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("off") / 0.4))
    return j.select("sid", "n", F.round(0.5 * cn + 0.5 * dist, 6).alias("score"), ((0.5 * cn + 0.5 * dist) > 0.5).alias("valid"))


def ge37(spark, d):
    near = spatial.with_nearest_site(atoms(spark, d), sites(spark, d), "sid", "idx")
    share = F.avg(((F.col("d") > 1.5) & (F.col("d") < 3.0)).cast("int"))
    g = near.groupBy("sid").agg(share.alias("share"), F.count_if(F.col("d") < 2.5).alias("bound"))
    score = F.when(F.col("bound") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 3 * F.col("share")))
    return g.select("sid", F.round(score, 6).alias("water_score"), (score > 0.4).alias("plausible"))


def ge38(spark, d):
    """Weighted plausibility; without docking the other weights are scaled up."""
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), *(F.abs(F.element_at("embedding", k).cast("double")).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))))
    dock = F.when(F.col("sid") % 3 != 0, F.col("b"))
    return s.select("sid", F.round(F.coalesce(0.4 * F.col("a") + 0.2 * dock + 0.4 * F.col("c"), (0.4 * F.col("a") + 0.4 * F.col("c")) / 0.8), 6).alias("plausibility"))


def ge40(spark, d):
    """Site localisation: predicted (site) against real (atoms 18 and 19); upper median and maximum."""
    real = atoms(spark, d).where("idx in (18, 19)").select("sid", *(F.col(c).alias(f"r{c}") for c in "xyz"))
    e = sites(spark, d).join(real, "sid").groupBy("sid", "site_idx").agg(F.min(distance(point(), point("r"))).alias("e"))
    e = e.select((F.col("sid") % 50).alias("panel"), "e")
    middle = upper_median(e, "panel", "e").select("panel", F.round("upper_median", 6).alias("median"))
    return middle.join(e.groupBy("panel").agg(F.round(F.max("e"), 6).alias("max"), F.count(F.lit(1)).alias("n")), "panel")


def ge41(spark, d):
    near = spatial.canonical_donors(atoms(spark, d), sites(spark, d), DONORS, 99.0)
    return near.groupBy("sid").agg(*(F.count_if(F.col("d") <= r).alias(n) for r, n in ((2.8, "n28"), (3.2, "n32"), (3.5, "n35"))))


def ge42(spark, d):
    """Largest chain by CA atoms; the smaller id of equals."""
    n = atoms(spark, d).groupBy("sid", "chain_id").agg(F.count_if(F.col("atom_name") == "CA").alias("n_ca"))
    return n.groupBy("sid").agg(F.min_by("chain_id", F.struct(-F.col("n_ca"), "chain_id")).alias("chain_id"), F.max("n_ca").alias("n_ca"))


ONE = {"ASP": "D", "CYS": "C", "HIS": "H"}


def ge43(spark, d):
    """Chain sequence in order of first occurrence; letters by the residue map, X beyond it."""
    a = atoms(spark, d).groupBy("sid", "chain_id", "res_id").agg(F.min("idx").alias("at"), F.min_by("res_name", "idx").alias("res_name"))
    letter = F.coalesce(*(F.when(F.col("res_name") == k, v) for k, v in ONE.items()), F.lit("X"))
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", letter.alias("l")))), lambda s: s["l"]), "")
    return a.groupBy("sid", "chain_id").agg(seq.alias("sequence"))


def ge45(spark, d):
    """Chain of each pocket residue: the chain whose CA with that number is nearest, within a limit."""
    ca = atoms(spark, d).where("idx % 2 = 0").select("sid", "res_id", "chain_id", *(F.col(c).alias(f"c{c}") for c in "xyz"))
    shift = atoms(spark, d).where("idx % 2 = 1").select("sid", "res_id", *"xyz")
    j = shift.join(ca, ["sid", "res_id"]).withColumn("d", distance(point(), point("c")))
    return j.groupBy("sid", "res_id").agg(F.min(F.struct("d", "chain_id")).alias("m")).where("m.d <= 3.0").select("sid", "res_id", "m.chain_id")


def ge46(spark, d):
    """Dominant chain: most resolved residues, the smaller id of equals."""
    n = ge45(spark, d).groupBy("sid", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("sid").agg(F.min_by("chain_id", F.struct(-F.col("n"), "chain_id")).alias("chain_id"))


def ge47(spark, d):
    """Local confidence: mean of the residues' mean b-factor over mapped donors."""
    a = atoms(spark, d)
    r = a.groupBy("sid", "res_id").agg(F.avg("b_factor").alias("b"))
    mapped = a.where("role <> 'HIS_N'").select("sid", "res_id").distinct()
    return mapped.join(r, ["sid", "res_id"]).groupBy("sid").agg(F.round(F.avg("b"), 6).alias("local_confidence"))


def ge48(spark, d):
    return atoms(spark, d).groupBy("sid").agg(F.round(F.avg("b_factor"), 6).alias("mean_plddt"), F.count_if(F.col("b_factor") < 70).alias("n_low"))


def ge49(spark, d):
    return atoms(spark, d).groupBy("sid").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("res_id").alias("n_residues"), *(F.round(f(c), 6).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"), *(F.count_if(F.col("element") == e).alias(f"n_{e.lower()}") for e in "CNOS"))


def fi13(spark, d):
    """Pocket checks as flags."""
    a = atoms(spark, d)
    flags = a.groupBy("sid").agg((F.count(F.lit(1)) >= 20).alias("enough_atoms"), (F.count_distinct("res_id") >= 8).alias("enough_residues"), F.bool_or(F.col("res_name") == "ASP").alias("charged"), F.bool_or(F.col("res_name") == "CYS").alias("polar"), (F.avg("b_factor") > 40).alias("confident"))
    near = spatial.with_nearest_site(a, sites(spark, d), "sid", "idx").groupBy("sid").agg(F.count_if(F.col("d") < 2.5).alias("cn"))
    return flags.join(near, "sid", "left").select(*flags.columns, F.col("cn").isNotNull().alias("has_site"), F.coalesce(F.col("cn").between(3, 6), F.lit(False)).alias("coordinated"))


def fi1(spark, d):
    """Protein atoms: structures with exactly one chain pass, others are refused with the number of chains."""
    n = atoms(spark, d).groupBy("sid").agg(F.count_distinct("chain_id").alias("n_chains"))
    return n.select("sid", "n_chains", F.when(F.col("n_chains") == 1, "ok").otherwise("refused").alias("status"))


QUERIES = {
    "fi1_one_chain": fi1, "fi3_canonical_donors": fi3, "fi4_heavy_atoms": fi4, "fi13_pocket_checks": fi13, "ge1_distance": ge1, "ge5_nearest_site": ge5, "ge10_pose_metrics": ge10, "ge11_pocket_pose": ge11, "ge17_sulfur_rule": ge17,
    "ge18_combined_status": ge18, "ge19_site_selection": ge19, "ge20_site_source": ge20, "ge21_pocket_extraction": ge21, "ge22_centroid": ge22, "ge23_within_radius": ge23, "ge24_first_shell": ge24, "ge25_radius_graph": ge25,
    "ge26_torsions": ge26, "ge27_ligand_metal": ge27, "ge28_radial_shell": ge28, "ge31_features": ge31, "tr10_graph_encoder": tr10, "ge32_angle": ge32, "ge34_valence": ge34, "ge33_ge35_fingerprint": ge35, "ge36_coordination": ge36, "ge37_water_proxy": ge37, "ge38_plausibility": ge38,
    "ge40_localisation": ge40, "ge41_donor_coverage": ge41, "ge42_largest_chain": ge42, "ge43_chain_sequence": ge43, "ge45_chain_resolution": ge45, "ge46_dominant_chain": ge46, "ge47_local_confidence": ge47, "ge48_plddt": ge48, "ge49_summary": ge49,
}

CAN = "((res_name = 'HIS' AND atom_name IN ('ND1', 'NE2')) OR (res_name = 'ASP' AND atom_name IN ('OD1', 'OD2')) OR (res_name = 'CYS' AND atom_name = 'SG'))"
POSE = f"""pose AS (SELECT sid, avg((d < 1.5)::INT) AS clash_share, avg((d <= 4.5)::INT) AS contact_share, min(d) AS min_distance, count(*) AS n_heavy FROM (
  SELECT a.sid, a.idx, min({D('a', 'b')}) AS d FROM atom a JOIN atom b ON a.sid = b.sid WHERE a.idx >= 15 AND b.idx < 15 GROUP BY ALL) GROUP BY sid)"""
SULFUR = """sulfur AS (SELECT s.sid, n.d, n.probability, CASE WHEN h.sid IS NULL THEN 'unavailable' WHEN n.d <= 3.0 THEN 'supported' ELSE 'not_supported' END AS status
  FROM structure s LEFT JOIN (SELECT DISTINCT sid FROM site) h USING (sid) LEFT JOIN (SELECT sid, min(d) AS d, arg_min(probability, (d, idx)) AS probability FROM near WHERE rn = 1 AND atom_name = 'SG' GROUP BY sid) n USING (sid))"""
IDEAL = {"tetrahedral": [109.5] * 6, "bipyramidal": sorted([90.0] * 6 + [120.0] * 3 + [180.0]), "octahedral": sorted([90.0] * 12 + [180.0] * 3)}
R0 = f"CASE element {' '.join(f'WHEN {e!r} THEN {r}' for e, r in spatial.VALENCE_RADII.items())} END"



def _torsion(p: str, q: str, r: str, s: str) -> tuple[str, str]:
    """Plain SQL for the (y, x) of a torsion, by the usual formula with normals."""
    v = lambda a, b: [f"({b}{c} - {a}{c})" for c in "xyz"]
    cr = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    dt = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
    b1, b2, b3 = v(p, q), v(q, r), v(r, s)
    n1, n2 = cr(b1, b2), cr(b2, b3)
    return f"sqrt({dt(b2, b2)}) * {dt(b1, n2)}", dt(n1, n2)


_PHI, _PSI = _torsion("pc", "n", "a", "c"), _torsion("n", "a", "c", "qn")
_BB = ", ".join(f"{k}.{c} AS {p}{c}" for k, p in (("u", "n"), ("v", "a"), ("w", "c")) for c in "xyz")

_SPOTS = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in enumerate(workers.sphere()))
_RADIUS = f"CASE element {' '.join(f'WHEN {e!r} THEN {r + workers.PROBE!r}' for e, r in workers.RADII.items())} ELSE {workers.OTHER + workers.PROBE!r} END::DOUBLE"
#: GE29 in SQL: the view area (sid, res_id, area).
AREA_SQL = f"""spot(k, ux, uy, uz) AS (VALUES {_SPOTS}), ball AS (SELECT *, {_RADIUS} AS r FROM atom),
  pr AS (SELECT a.sid, a.idx, b.x - a.x AS vx, b.y - a.y AS vy, b.z - a.z AS vz, a.r AS ra, b.r AS rb FROM ball a JOIN ball b ON b.sid = a.sid AND b.idx <> a.idx),
  cap AS (SELECT *, (d * d + ra * ra - rb * rb) / (2 * ra) AS beyond FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS d FROM pr) WHERE d < ra + rb),
  hid AS (SELECT sid, idx, count(DISTINCT k) AS n FROM cap JOIN spot ON vx * ux + vy * uy + vz * uz > beyond GROUP BY ALL),
  area AS (SELECT sid, res_id, sum(4 * pi() * r * r * (1 - coalesce(n, 0) / {len(workers.sphere())}) / 100) AS area FROM ball LEFT JOIN hid USING (sid, idx) GROUP BY ALL)"""
_OFF = lambda want: f"CASE WHEN len(l) = {len(want)} THEN sqrt(list_sum(list_transform(list_zip(l, {want}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / {len(want)}) END"
FINGERPRINT_SQL = {
    "coordination_number": "cn", "donor_n": "n_n", "donor_o": "n_o", "donor_s": "n_s", **{f"distance_{k}": f"ds[{k}]" for k in range(1, 7)}, "angle_mean": "am", "angle_std": "sd", "angle_min": "lo", "angle_max": "hi",
    **{f"deviation_{k}": _OFF(w) for k, w in spatial.IDEAL.items()}, "valence_sum": "valence", "valence_deviation": "abs(valence - 2)", "second_shell": "CASE WHEN cn > 0 THEN shell END", "area": "area",
    "site_gap": "CASE WHEN n_sites = 2 THEN gap END", "n_metal_sites": "n_sites", "has_metal": "1",
}
TURN_SQL = f"""bb AS (SELECT u.sid, u.idx // 3 AS res_id, {_BB} FROM atom u JOIN atom v ON v.sid = u.sid AND v.idx = u.idx + 1 JOIN atom w ON w.sid = u.sid AND w.idx = u.idx + 2 WHERE u.idx % 3 = 0 AND (u.sid + u.idx // 3) % 11 <> 0),
      j AS (SELECT b.*, p.cx AS pcx, p.cy AS pcy, p.cz AS pcz, q.nx AS qnx, q.ny AS qny, q.nz AS qnz FROM bb b LEFT JOIN bb p ON p.sid = b.sid AND p.res_id = b.res_id - 1 LEFT JOIN bb q ON q.sid = b.sid AND q.res_id = b.res_id + 1),
      t AS (SELECT sid, res_id, pcx IS NOT NULL AND qnx IS NOT NULL AS ok, atan2({_PHI[0]}, {_PHI[1]}) AS phi, atan2({_PSI[0]}, {_PSI[1]}) AS psi FROM j)"""
ORACLE_SQL = {
    "fi1_one_chain": f"WITH {ATOM_SQL} SELECT sid, count(DISTINCT chain_id) AS n_chains, CASE WHEN count(DISTINCT chain_id) = 1 THEN 'ok' ELSE 'refused' END AS status FROM atom GROUP BY sid",
    "fi3_canonical_donors": f"WITH {AS}, {NEAR} SELECT sid, idx, element, site_idx, round(d, 6) AS d FROM near WHERE rn = 1 AND d <= 3.5 AND {CAN}",
    "fi4_heavy_atoms": f"WITH {ATOM_SQL} SELECT element, count(*) AS n FROM atom WHERE upper(element) NOT IN ('H', 'D') GROUP BY element",
    "fi13_pocket_checks": f"""WITH {AS}, {NEAR}, c AS (SELECT sid, count(*) FILTER (WHERE d < 2.5) AS cn FROM near WHERE rn = 1 GROUP BY sid)
      SELECT a.sid, count(*) >= 20 AS enough_atoms, count(DISTINCT res_id) >= 8 AS enough_residues, bool_or(res_name = 'ASP') AS charged, bool_or(res_name = 'CYS') AS polar, avg(b_factor) > 40 AS confident,
        any_value(cn) IS NOT NULL AS has_site, coalesce(any_value(cn) BETWEEN 3 AND 6, false) AS coordinated FROM atom a LEFT JOIN c USING (sid) GROUP BY a.sid""",
    "ge1_distance": "SELECT a.vec_id AS a, round(list_distance(list_transform(a.embedding, lambda z: z::DOUBLE), list_transform(b.embedding, lambda z: z::DOUBLE)), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "ge5_nearest_site": f"WITH {AS}, {NEAR} SELECT sid, idx, site_idx, round(d, 6) AS d FROM near WHERE rn = 1",
    "ge10_pose_metrics": f"WITH {ATOM_SQL}, {POSE} SELECT sid, round(clash_share, 6) AS clash_share, round(contact_share, 6) AS contact_share, round(min_distance, 6) AS min_distance, n_heavy FROM pose",
    "ge11_pocket_pose": f"""WITH {AS}, {POSE}, m AS (SELECT a.sid, min({D('a', 's')}) AS min_metal, min({D('a', 's')}) FILTER (WHERE element IN ('N', 'O', 'S')) AS min_hetero_metal FROM atom a JOIN site s USING (sid) WHERE a.idx >= 15 GROUP BY a.sid)
      SELECT sid, round(clash_share, 6) AS clash_share, round(contact_share, 6) AS contact_share, round(min_distance, 6) AS min_distance, n_heavy, round(min_metal, 6) AS min_metal, round(min_hetero_metal, 6) AS min_hetero_metal FROM pose LEFT JOIN m USING (sid)""",
    "ge17_sulfur_rule": f"WITH {AS}, {STRUCT_SQL}, {NEAR}, {SULFUR} SELECT sid, status, round(d, 6) AS distance, round(probability, 6) AS probability FROM sulfur",
    "ge18_combined_status": f"""WITH {AS}, {STRUCT_SQL}, {NEAR}, {SULFUR}, n AS (SELECT sid, count(*) AS k FROM site GROUP BY sid)
      SELECT sid, CASE WHEN label = 'positive' AND sid % 2 = 0 THEN 'supported' WHEN status = 'supported' THEN 'partial_support' WHEN k IS NULL THEN 'unavailable' WHEN k <> 2 THEN 'not_applicable' ELSE 'not_supported' END AS combined
      FROM structure JOIN sulfur USING (sid) LEFT JOIN n USING (sid)""",
    "ge19_site_selection": f"""WITH {ATOM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY b_factor / 400 DESC, idx) AS rk FROM atom WHERE idx >= 15),
      k AS (SELECT r.sid, r.idx, r.rk FROM r JOIN r t ON t.sid = r.sid AND t.rk = 1 WHERE r.rk = 1 OR {D('r', 't')} <= 5.0)
      SELECT sid, idx AS site_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rk)::INT AS rank FROM k) WHERE rank <= 2""",
    "ge20_site_source": f"WITH {SITE_SQL} SELECT e.vec_id AS sid, CASE WHEN p >= 0.5 THEN 'metal' WHEN e.vec_id % 2 = 0 THEN 'cavity' ELSE 'error' END AS source FROM embeddings e LEFT JOIN (SELECT sid, max(probability) AS p FROM site GROUP BY sid) ON sid = e.vec_id",
    "ge21_pocket_extraction": f"""WITH {AS}, {CENTRE}, k AS (SELECT DISTINCT res.sid, res_id FROM res JOIN site s USING (sid) WHERE {D('res', 's')} <= 6.0)
      SELECT sid, count(*) AS n_atoms, count(DISTINCT res_id) AS n_residues, count(*) FILTER (WHERE atom_name NOT IN ('N', 'CA', 'C', 'O')) AS n_sidechain FROM atom JOIN k USING (sid, res_id) GROUP BY sid""",
    "ge22_centroid": f"WITH {ATOM_SQL}, {CENTRE} SELECT sid, res_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM res",
    "ge23_within_radius": f"WITH {AS}, {CENTRE.replace('n = 1', 'n >= 1')} SELECT sid, count(*) AS n FROM (SELECT DISTINCT res.sid, res_id FROM res JOIN site s USING (sid) WHERE {D('res', 's')} <= 5.0) GROUP BY sid",
    "ge24_first_shell": f"WITH {AS}, {NEAR} SELECT DISTINCT sid, res_id FROM near WHERE rn = 1 AND d <= 2.8 AND {CAN}",
    "ge25_radius_graph": f"WITH {ATOM_SQL}, {CENTRE} SELECT a.sid, a.res_id AS src, b.res_id AS dst, round({D('a', 'b')}, 6) AS distance, abs(a.res_id - b.res_id) = 1 AS is_adjacent FROM res a JOIN res b ON a.sid = b.sid AND a.res_id <> b.res_id WHERE {D('a', 'b')} <= 4.0 OR abs(a.res_id - b.res_id) = 1",
    "ge26_torsions": f"""WITH {ATOM_SQL}, {TURN_SQL}
      SELECT sid, res_id, {", ".join(f"round(CASE WHEN ok THEN {f}({a}) ELSE 0 END, 6) AS {f}_{a}" for f in ("sin", "cos") for a in ("phi", "psi"))} FROM t""",
    "ge31_features": f"""WITH {AS}, {NEAR}, {CENTRE}, {AREA_SQL}, {TURN_SQL}, nm(name, nth, p) AS (VALUES {", ".join(f"('{n}', {k}, {[float(v) for v in p]}::DOUBLE[])" for k, (n, p) in enumerate(spatial.RESIDUES.items()))}),
      r AS (SELECT sid, res_id, arg_min(res_name, idx) AS name, max((atom_name NOT IN {spatial.BACKBONE})::INT)::DOUBLE AS side FROM atom GROUP BY ALL),
      cm AS (SELECT res.sid, res_id, min({D('res', 's')}) AS d FROM res JOIN site s USING (sid) GROUP BY ALL), lg AS (SELECT sid, res_id, min(d) AS m FROM near WHERE rn = 1 AND {CAN} GROUP BY ALL),
      f AS (SELECT r.sid, r.res_id, list_concat(list_transform(range(0, 20), lambda k: (k = nth)::INT::DOUBLE), [side, coalesce(cm.d, 0)], p, [coalesce(m, 0), coalesce(m <= 2.8, false)::INT::DOUBLE],
          CASE WHEN ok THEN [sin(phi), cos(phi), sin(psi), cos(psi)] ELSE [0.0, 0.0, 0.0, 0.0]::DOUBLE[] END, [area], [coalesce(cm.d < 5, false)::INT::DOUBLE, coalesce(cm.d >= 5 AND cm.d < 9, false)::INT::DOUBLE, coalesce(cm.d >= 9, false)::INT::DOUBLE],
          list_transform(embedding, lambda x: CASE WHEN r.res_id % 9 <> 8 THEN x::DOUBLE * (r.res_id + 1) ELSE 0 END)) AS f
        FROM r JOIN nm ON nm.name = r.name LEFT JOIN cm USING (sid, res_id) LEFT JOIN lg USING (sid, res_id) LEFT JOIN t USING (sid, res_id) LEFT JOIN area USING (sid, res_id) JOIN embeddings ON vec_id = r.sid)
      SELECT sid, res_id, len(f) AS width, round(list_sum(list_transform(f, lambda x, i: x * i)), 4) AS total FROM f""",
    "ge27_ligand_metal": f"""WITH {AS}, {NEAR}, m AS (SELECT sid, res_id, min(d) AS m FROM near WHERE rn = 1 AND {CAN} GROUP BY ALL)
      SELECT sid, res_id, round(coalesce(m, 0), 6) AS metal_distance, coalesce(m <= 2.8, false)::INT AS bonded FROM (SELECT DISTINCT sid, res_id FROM atom) LEFT JOIN m USING (sid, res_id)""",
    "ge28_radial_shell": f"""WITH {AS}, {CENTRE}, n AS (SELECT res.sid, res_id, min({D('res', 's')}) AS d FROM res LEFT JOIN site s USING (sid) GROUP BY ALL)
      SELECT sid, coalesce(count(*) FILTER (WHERE d < 5), 0) AS shell0, count(*) FILTER (WHERE d >= 5 AND d < 9) AS shell1, count(*) FILTER (WHERE d >= 9) AS shell2 FROM n GROUP BY sid""",
    "ge32_angle": f"""WITH {ATOM_SQL} SELECT b.sid, round(degrees(acos(greatest(-1.0, least(1.0, ((a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) + (a.z - b.z) * (c.z - b.z)) / ({D('a', 'b')} * {D('c', 'b')} + 1e-8))))), 5) AS angle
      FROM atom b JOIN atom a ON a.sid = b.sid AND a.idx = 0 JOIN atom c ON c.sid = b.sid AND c.idx = 2 WHERE b.idx = 1""",
    "ge34_valence": f"WITH {AS}, {NEAR} SELECT sid, round(sum(exp(({R0} - d) / 0.37)), 6) AS valence FROM near WHERE rn = 1 AND d <= 4.0 AND {CAN} GROUP BY sid",
    "ge33_ge35_fingerprint": f"""WITH {AS}, {STRUCT_SQL}, {NEAR}, {AREA_SQL}, don AS (SELECT * FROM near WHERE rn = 1 AND d <= 5.0 AND {CAN}),
      p AS (SELECT sid, min(site_idx) AS k, count(*) AS n_sites FROM site GROUP BY sid), ps AS (SELECT s.sid, s.x, s.y, s.z FROM site s JOIN p ON p.sid = s.sid AND p.k = s.site_idx),
      c AS (SELECT sid, count(*) AS cn, count(*) FILTER (WHERE element = 'N') AS n_n, count(*) FILTER (WHERE element = 'O') AS n_o, count(*) FILTER (WHERE element = 'S') AS n_s,
        sum(exp(({R0} - d) / 0.37)) AS valence, list_sort(list(d)) AS ds FROM don GROUP BY sid),
      an AS (SELECT a.sid, degrees(acos(greatest(-1.0, least(1.0, ((a.x - s.x) * (b.x - s.x) + (a.y - s.y) * (b.y - s.y) + (a.z - s.z) * (b.z - s.z)) / ({D('a', 's')} * {D('b', 's')} + 1e-8))))) AS a FROM don a JOIN don b ON a.sid = b.sid AND a.idx < b.idx JOIN ps s ON s.sid = a.sid),
      st AS (SELECT sid, avg(a) AS am, stddev_pop(a) AS sd, min(a) AS lo, max(a) AS hi, list_sort(list(a)) AS l FROM an GROUP BY sid),
      own AS (SELECT DISTINCT sid, res_id FROM don),
      po AS (SELECT a.* FROM atom a LEFT JOIN own USING (sid, res_id) WHERE element IN ('N', 'O') AND NOT ({CAN} AND own.sid IS NOT NULL)),
      hb AS (SELECT a.sid, count(DISTINCT a.idx) AS n FROM po a JOIN don o ON o.sid = a.sid AND {D('a', 'o')} <= {spatial.SECOND_SHELL} GROUP BY a.sid),
      ex AS (SELECT sid, sum(area) AS area FROM area JOIN own USING (sid, res_id) GROUP BY sid),
      g AS (SELECT a.sid, min({D('a', 'b')}) AS gap FROM site a JOIN site b ON a.sid = b.sid AND a.site_idx < b.site_idx GROUP BY a.sid),
      j AS (SELECT t.sid, n_sites, coalesce(cn, 0) AS cn, coalesce(n_n, 0) AS n_n, coalesce(n_o, 0) AS n_o, coalesce(n_s, 0) AS n_s, ds, am, sd, lo, hi, l, coalesce(valence, 0) AS valence, coalesce(hb.n, 0) AS shell, coalesce(area, 0) AS area, gap
        FROM structure t LEFT JOIN p USING (sid) LEFT JOIN c USING (sid) LEFT JOIN st USING (sid) LEFT JOIN hb USING (sid) LEFT JOIN ex USING (sid) LEFT JOIN g USING (sid))
      SELECT sid, {", ".join(f"CASE WHEN n_sites IS NULL THEN 0.0 ELSE round(({e})::DOUBLE, 4) END AS {k}" for k, e in FINGERPRINT_SQL.items())} FROM j""",
    "ge36_coordination": f"""WITH {AS}, {STRUCT_SQL}, {NEAR}, c AS (SELECT sid, count(*) AS n, avg(abs(d - 2.1)) AS m FROM near WHERE rn = 1 AND element IN ('N', 'O', 'S') AND d < 2.5 GROUP BY sid),
      v AS (SELECT sid, coalesce(n, 0) AS n, 0.5 * (CASE WHEN n BETWEEN 3 AND 5 THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE greatest(0.0, 1 - 0.25 * abs(n - 4)) END) + 0.5 * (CASE WHEN n IS NULL THEN 0.0 ELSE greatest(0.0, 1 - m / 0.4) END) AS s FROM structure LEFT JOIN c USING (sid))
      SELECT sid, n, round(s, 6) AS score, s > 0.5 AS valid FROM v""",
    "ge37_water_proxy": f"""WITH {AS}, {NEAR}, g AS (SELECT sid, avg((d > 1.5 AND d < 3.0)::INT) AS f, count(*) FILTER (WHERE d < 2.5) AS b FROM near WHERE rn = 1 GROUP BY sid)
      SELECT sid, round(CASE WHEN b = 0 THEN 0.0 ELSE greatest(0.0, 1 - 3 * f) END, 6) AS water_score, CASE WHEN b = 0 THEN 0.0 ELSE greatest(0.0, 1 - 3 * f) END > 0.4 AS plausible FROM g""",
    "ge38_plausibility": "SELECT vec_id AS sid, round(CASE WHEN vec_id % 3 <> 0 THEN 0.4 * abs(embedding[1]::DOUBLE) + 0.2 * abs(embedding[2]::DOUBLE) + 0.4 * abs(embedding[3]::DOUBLE) ELSE (0.4 * abs(embedding[1]::DOUBLE) + 0.4 * abs(embedding[3]::DOUBLE)) / 0.8 END, 6) AS plausibility FROM embeddings",
    "ge40_localisation": f"""WITH {AS}, e AS (SELECT s.sid, s.site_idx, min({D('s', 'a')}) AS e FROM site s JOIN atom a ON a.sid = s.sid AND a.idx IN (18, 19) GROUP BY ALL), g AS (SELECT sid % 50 AS panel, list_sort(list(e)) AS l FROM e GROUP BY ALL)
      SELECT panel, round(l[len(l) // 2 + 1], 6) AS median, round(l[len(l)], 6) AS max, len(l) AS n FROM g""",
    "ge41_donor_coverage": f"WITH {AS}, {NEAR} SELECT sid, count(*) FILTER (WHERE d <= 2.8) AS n28, count(*) FILTER (WHERE d <= 3.2) AS n32, count(*) FILTER (WHERE d <= 3.5) AS n35 FROM near WHERE rn = 1 AND {CAN} GROUP BY sid",
    "ge42_largest_chain": f"WITH {ATOM_SQL}, n AS (SELECT sid, chain_id, count(*) FILTER (WHERE atom_name = 'CA') AS n_ca FROM atom GROUP BY ALL) SELECT sid, chain_id, n_ca FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n_ca DESC, chain_id) AS rn FROM n) WHERE rn = 1",
    "ge43_chain_sequence": f"""WITH {ATOM_SQL}, r AS (SELECT sid, chain_id, res_id, min(idx) AS i, arg_min(res_name, idx) AS n FROM atom GROUP BY ALL)
      SELECT sid, chain_id, string_agg(CASE n WHEN 'ASP' THEN 'D' WHEN 'CYS' THEN 'C' WHEN 'HIS' THEN 'H' ELSE 'X' END, '' ORDER BY i) AS sequence FROM r GROUP BY ALL""",
    "ge45_chain_resolution": f"WITH {ATOM_SQL} SELECT a.sid, a.res_id, arg_min(b.chain_id, ({D('a', 'b')}, b.chain_id)) AS chain_id FROM atom a JOIN atom b ON a.sid = b.sid AND a.res_id = b.res_id WHERE a.idx % 2 = 1 AND b.idx % 2 = 0 GROUP BY ALL HAVING min({D('a', 'b')}) <= 3.0",
    "ge46_dominant_chain": f"""WITH {ATOM_SQL}, c AS (SELECT a.sid, a.res_id, arg_min(b.chain_id, ({D('a', 'b')}, b.chain_id)) AS chain_id FROM atom a JOIN atom b ON a.sid = b.sid AND a.res_id = b.res_id WHERE a.idx % 2 = 1 AND b.idx % 2 = 0 GROUP BY ALL HAVING min({D('a', 'b')}) <= 3.0),
      n AS (SELECT sid, chain_id, count(*) AS n FROM c GROUP BY ALL) SELECT sid, chain_id FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, chain_id) AS rn FROM n) WHERE rn = 1""",
    "ge47_local_confidence": f"WITH {ATOM_SQL}, r AS (SELECT sid, res_id, avg(b_factor) AS b, bool_or(role <> 'HIS_N') AS m FROM atom GROUP BY ALL) SELECT sid, round(avg(b), 6) AS local_confidence FROM r WHERE m GROUP BY sid",
    "ge48_plddt": f"WITH {ATOM_SQL} SELECT sid, round(avg(b_factor), 6) AS mean_plddt, count(*) FILTER (WHERE b_factor < 70) AS n_low FROM atom GROUP BY sid",
    "ge49_summary": f"WITH {ATOM_SQL} SELECT sid, count(*) AS n_atoms, count(DISTINCT res_id) AS n_residues, {', '.join(f'round({f}({c}), 6) AS {f}_{c}' for f in ('min', 'max') for c in 'xyz')}, {', '.join(f'''count(*) FILTER (WHERE element = '{e}') AS n_{e.lower()}''' for e in 'CNOS')} FROM atom GROUP BY sid",
}
