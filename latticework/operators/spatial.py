"""Distance-bounded joins inside structures, and what is computed from them.

Atoms: sid, idx, res_id, atom_name, res_name, element, x, y, z.  Sites: sid, site_idx, probability, x, y, z.
``range_join`` uses a grid, so a radius join stays an equi-join at any density; joins with a handful of sites
per structure need no grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle_degrees, bond_valence, distance, point, with_torsion

BACKBONE = ("N", "CA", "C", "O")
#: Fixed values of the twenty residues: hydropathy, charge, polar, volume, aromatic, hydrogen-bond donors, acceptors,
#: can bind zinc.
RESIDUES = {
    "ALA": (1.8, 0, 0, 0.88, 0, 0, 0, 0),
    "ARG": (-4.5, 1, 1, 1.73, 0, 5, 0, 0),
    "ASN": (-3.5, 0, 1, 1.14, 0, 2, 2, 0),
    "ASP": (-3.5, -1, 1, 1.11, 0, 1, 3, 1),
    "CYS": (2.5, 0, 0, 1.08, 0, 1, 0, 1),
    "GLN": (-3.5, 0, 1, 1.44, 0, 2, 2, 0),
    "GLU": (-3.5, -1, 1, 1.38, 0, 1, 3, 1),
    "GLY": (-0.4, 0, 0, 0.60, 0, 0, 0, 0),
    "HIS": (-3.2, 0, 1, 1.53, 1, 2, 1, 1),
    "ILE": (4.5, 0, 0, 1.67, 0, 0, 0, 0),
    "LEU": (3.8, 0, 0, 1.67, 0, 0, 0, 0),
    "LYS": (-3.9, 1, 1, 1.69, 0, 3, 0, 0),
    "MET": (1.9, 0, 0, 1.62, 0, 0, 0, 0),
    "PHE": (2.8, 0, 0, 1.89, 1, 0, 0, 0),
    "PRO": (-1.6, 0, 0, 1.13, 0, 0, 0, 0),
    "SER": (-0.8, 0, 1, 0.89, 0, 1, 1, 0),
    "THR": (-0.7, 0, 1, 1.16, 0, 1, 1, 0),
    "TRP": (-0.9, 0, 1, 2.28, 1, 1, 0, 0),
    "TYR": (-1.3, 0, 1, 1.94, 1, 1, 1, 0),
    "VAL": (4.2, 0, 0, 1.40, 0, 0, 0, 0),
}


def residue_features(res_name: Column) -> Column:
    """GE30: one-hot over the twenty residues, then their eight properties; zeros for any other residue."""
    one = lambda k: [float(k == j) for j in range(len(RESIDUES))]
    rows = [F.when(res_name == r, F.array(*(F.lit(float(v)) for v in (*one(k), *p)))) for k, (r, p) in enumerate(RESIDUES.items())]
    return F.coalesce(*rows, F.array_repeat(F.lit(0.0), len(RESIDUES) + 8))


def range_join(left: DataFrame, right: DataFrame, radius: float, prefix: str = "r_") -> DataFrame:
    """Pairs of one structure within ``radius``: all columns of ``left``, those of ``right`` prefixed, ``d``.

    Points are hashed to cells as wide as the radius; the right side visits its 27 neighbouring cells.  Spark's estimate
    of that side does not know the 27, so the join is told not to broadcast it.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    a = left.withColumns({f"__{c}": cell(c) for c in "xyz"})
    steps = F.array(*(F.lit(v) for v in (-1, 0, 1)))
    b = right
    for c in "xyz":
        b = b.withColumn("__s", F.explode(steps)).withColumn(f"__{c}", cell(c) + F.col("__s")).drop("__s")
    b = b.select(F.col("sid"), *(f"__{c}" for c in "xyz"), *(F.col(c).alias(f"{prefix}{c}") for c in right.columns if c != "sid"))
    joined = a.join(b.hint("merge"), ["sid", "__x", "__y", "__z"]).withColumn("d", distance(point(), point(prefix)))
    return joined.where(F.col("d") <= radius).drop("__x", "__y", "__z")


def with_nearest_site(points: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """GE5: each point with its nearest site (``site_idx``, ``d``, ``site_probability``); the first of equals."""
    s = sites.select("sid", "site_idx", F.col("probability").alias("__p"), *(F.col(c).alias(f"__s{c}") for c in "xyz"))
    joined = points.join(s, "sid").withColumn("__d", distance(point(), point("__s")))
    first = F.min(F.struct(F.col("__d").alias("d"), F.col("site_idx"), F.col("__p").alias("site_probability"))).alias("__n")
    near = joined.groupBy(*keys).agg(first).select(*keys, "__n.*")
    return points.join(near, list(keys))


def canonical_donors(atoms: DataFrame, sites: DataFrame, donors: dict[str, tuple[str, ...]], limit: float = 2.9) -> DataFrame:
    """FI3: donor atoms of their residue within ``limit`` of the nearest site."""
    ok = F.lit(False)
    for res, names in donors.items():
        ok = ok | ((F.col("res_name") == res) & F.col("atom_name").isin(*names))
    return with_nearest_site(atoms.where(ok), sites, "sid", "idx").where(F.col("d") <= limit)


def pose_metrics(ligand: DataFrame, protein: DataFrame, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """GE10: per structure (and ``keys``) the shares of ligand atoms that clash (< 1.5) and touch (<= 4.5), and the
    least distance, however far.  ligand: sid, keys, lig, x, y, z and the columns to carry, which are the same in
    all its rows; both sides heavy atoms only.  (The least distance needs every pair of a structure's atoms, so there
    is no grid: they meet by structure and leave each task as one minimum.)"""
    other = protein.select("sid", *(F.col(c).alias(f"__p{c}") for c in "xyz"))
    same = [F.first(c).alias(c) for c in carry]
    near = ligand.join(other, "sid", "left").groupBy("sid", *keys, "lig").agg(F.min(distance(point(), point("__p"))).alias("d"), *same)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return near.groupBy("sid", *keys).agg(
        F.avg(one(F.col("d") < 1.5)).alias("clash_share"), F.avg(one(F.col("d") <= 4.5)).alias("contact_share"), F.min("d").alias("min_distance"), F.count(F.lit(1)).alias("n_heavy"), *same
    )


def metal_metrics(ligand: DataFrame, sites: DataFrame) -> DataFrame:
    """GE11's metal part: least distance of any, and of a N, O or S ligand atom, to a site (null if none)."""
    j = ligand.join(sites.select("sid", *(F.col(c).alias(f"s{c}") for c in "xyz")), "sid").withColumn("d", distance(point(), point("s")))
    return j.groupBy("sid").agg(F.min("d").alias("min_metal"), F.min(F.when(F.col("element").isin("N", "O", "S"), F.col("d"))).alias("min_hetero_metal"))


def sulfur_rule(structures: DataFrame, atoms: DataFrame, sites: DataFrame, limit: float = 2.8) -> DataFrame:
    """GE17: unavailable without a site; not_supported without a cysteine sulfur (nulls) or beyond the limit;
    supported within it.  The first sulfur wins ties."""
    sulfur = atoms.where((F.col("res_name") == "CYS") & (F.col("atom_name") == "SG"))
    near = with_nearest_site(sulfur, sites, "sid", "idx").groupBy("sid").agg(F.min(F.struct("d", "idx", "site_probability")).alias("n"))
    has = sites.select("sid").distinct().withColumn("has_site", F.lit(True))
    j = structures.select("sid").join(has, "sid", "left").join(near, "sid", "left")
    status = F.when(F.col("has_site").isNull(), "unavailable").when(F.coalesce(F.col("n.d") <= limit, F.lit(False)), "supported").otherwise("not_supported")
    return j.select("sid", status.alias("status"), F.col("n.d").alias("distance"), F.col("n.site_probability").alias("probability"))


def select_sites(probes: DataFrame, reach: float = 5.0) -> DataFrame:
    """GE19: the most probable probe, and the most probable other one within ``reach`` of it."""
    by = Window.partitionBy("sid").orderBy(F.desc("probability"), "site_idx")
    ranked = probes.withColumn("rank", F.row_number().over(by))
    top = ranked.where("rank = 1").select("sid", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    near = ranked.join(top, "sid").where((F.col("rank") == 1) | (distance(point(), point("t")) <= reach))
    return near.withColumn("rank", F.row_number().over(by)).where("rank <= 2").select("sid", "site_idx", "rank")


def centroids(atoms: DataFrame, lone: bool = True) -> DataFrame:
    """GE22: per residue the CA (``lone``: if there is exactly one; else the first of several), else the mean."""
    ca = F.col("atom_name") == "CA"
    first = lambda c: F.min_by(F.when(ca, F.col(c)), F.when(ca, F.col("idx")))
    g = atoms.groupBy("sid", "res_id").agg(F.count_if(ca).alias("n"), *(first(c).alias(f"c{c}") for c in "xyz"), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
    use = F.col("n") == 1 if lone else F.col("n") >= 1
    return g.select("sid", "res_id", *(F.when(use, F.col(f"c{c}")).otherwise(F.col(f"m{c}")).alias(c) for c in "xyz"))


def residues_within(residues: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """GE21 and GE23: residues (sid, res_id, x, y, z) whose point lies within the radius of a site."""
    s = sites.select("sid", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    return residues.join(s, "sid").where(distance(point(), point("s")) <= radius).select("sid", "res_id").distinct()


def extract_pocket(atoms: DataFrame, sites: DataFrame, radius: float = 12.0) -> DataFrame:
    """GE21: all atoms of the residues within the radius, with a side-chain flag."""
    kept = residues_within(centroids(atoms), sites, radius)
    return atoms.join(kept, ["sid", "res_id"], "left_semi").withColumn("is_sidechain", ~F.col("atom_name").isin(*BACKBONE))


def radius_graph(residues: DataFrame, radius: float = 10.0) -> DataFrame:
    """GE25: directed edges src, dst, distance, is_adjacent: within the radius, or neighbours in sequence."""
    r = residues.select("sid", F.col("res_id"), *"xyz")
    near = range_join(r, r, radius).where("res_id <> r_res_id").select("sid", F.col("res_id").alias("src"), F.col("r_res_id").alias("dst"), "d")
    t = r.select("sid", F.col("res_id").alias("dst"), *(F.col(c).alias(f"t{c}") for c in "xyz"))
    s = r.select("sid", F.col("res_id").alias("src"), F.explode(F.array(F.col("res_id") - 1, F.col("res_id") + 1)).alias("dst"), *"xyz")
    side = s.join(t, ["sid", "dst"]).select("sid", "src", "dst", distance(point(), point("t")).alias("d"))
    both = near.union(side).groupBy("sid", "src", "dst").agg(F.min("d").alias("distance"))
    return both.withColumn("is_adjacent", F.abs(F.col("src") - F.col("dst")) == 1)


def backbone_torsions(backbone: DataFrame) -> DataFrame:
    """GE26: sine and cosine of phi and psi where both neighbours (by number) are complete, else zeros.
    backbone: sid, res_id, and nx..nz, ax..az, cx..cz of N, CA and C."""
    cols = [f"{a}{c}" for a in "nac" for c in "xyz"]
    shift = lambda k, p: backbone.select("sid", (F.col("res_id") + k).alias("res_id"), *(F.col(c).alias(f"{p}{c}") for c in cols))
    j = backbone.join(shift(1, "p"), ["sid", "res_id"], "left").join(shift(-1, "q"), ["sid", "res_id"], "left")
    ok = F.col("pcx").isNotNull() & F.col("qnx").isNotNull()
    j = with_torsion(j, "phi", point("pc"), point("n"), point("a"), point("c"))
    j = with_torsion(j, "psi", point("n"), point("a"), point("c"), point("qn"))
    return j.select("sid", "res_id", *(F.when(ok, f(a)).otherwise(0.0).alias(f"{n}_{a}") for n, f in (("sin", F.sin), ("cos", F.cos)) for a in ("phi", "psi")))


def shell(d: Column) -> Column:
    """GE28: one-hot of [0, 5), [5, 9), [9, inf); zeros for null."""
    return F.array(*(F.coalesce(c, F.lit(False)).cast("int") for c in (d < 5, (d >= 5) & (d < 9), d >= 9)))


def node_features(atoms: DataFrame, sites: DataFrame, backbone: DataFrame, embeddings: DataFrame, area: DataFrame, donors: dict[str, tuple[str, ...]], bond: float = 2.8) -> DataFrame:
    """GE31: sid, res_id, features of each residue: one-hot of twenty residues, side-chain flag, distance of the centroid
    to the nearest metal, eight properties, least distance of a ligand atom to a metal and whether it is a bond, sines
    and cosines of both torsions, accessible area, one-hot of three shells, and the residue's embedding.

    What does not exist counts as 0 (no metal, no ligand atom, a torsion without both neighbours, no embedding).
    backbone: as ``backbone_torsions`` takes it; embeddings: sid, res_id, v, of one width; area: sid, res_id, area."""
    canonical = F.lit(False)
    for name, names in donors.items():
        canonical = canonical | ((F.col("res_name") == name) & F.col("atom_name").isin(*names))
    key = ["sid", "res_id"]
    residues = atoms.groupBy(*key).agg(F.min_by("res_name", "idx").alias("res_name"), F.max((~F.col("atom_name").isin(*BACKBONE)).cast("double")).alias("side"))
    centre = with_nearest_site(centroids(atoms, lone=False).withColumn("idx", F.col("res_id")), sites, "sid", "idx").select(*key, F.col("d").alias("to_metal"))
    bound = with_nearest_site(atoms.where(canonical), sites, "sid", "idx").groupBy(*key).agg(F.min("d").alias("ligand"))
    torsions = backbone_torsions(backbone).select(*key, F.array("sin_phi", "cos_phi", "sin_psi", "cos_psi").alias("turns"))
    width = embeddings.agg(F.max(F.size("v"))).first()[0] or 0
    j = residues
    for side in (centre, bound, torsions, area.select(*key, "area"), embeddings.select(*key, "v")):
        j = j.join(side, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    zeros = lambda c, n: F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), n))
    own, n = residue_features(F.col("res_name")), len(RESIDUES)
    bonded = F.coalesce(F.col("ligand") <= bond, F.lit(False)).cast("double")
    rest = F.concat(F.array(zero("ligand"), bonded), zeros("turns", 4), F.array(zero("area")), F.transform(shell(F.col("to_metal")), lambda x: x.cast("double")), zeros("v", width))
    return j.select(*key, F.concat(F.slice(own, 1, n), F.array(zero("side"), zero("to_metal")), F.slice(own, n + 1, 8), rest).alias("features"))


#: Bond-valence radii, ideal angles by coordination, and how far a second shell reaches.
VALENCE_RADII = {"N": 1.77, "O": 1.70, "S": 2.01}
IDEAL = {"tetrahedral": [109.5] * 6, "bipyramidal": [90.0] * 6 + [120.0] * 3 + [180.0], "octahedral": [90.0] * 12 + [180.0] * 3}
SECOND_SHELL = 3.5


def coordination_fingerprint(structures: DataFrame, atoms: DataFrame, sites: DataFrame, donors: dict[str, tuple[str, ...]], area: DataFrame, limit: float = 2.8) -> DataFrame:
    """GE35: sid and 24 numbers: coordination number, counts by element, six nearest distances, angles of all donors at
    the first site, deviations from the ideal angles, bond-valence sum and its deviation from 2, polar atoms of the
    second shell, accessible area of the donors' residues, distance between two sites, number of sites, has_metal.

    Without a site all are 0.  With one, what cannot be measured is null: distances beyond the coordination number,
    angles of fewer than two donors, deviations at another number of angles, a second shell without donors, a distance
    where there are not two sites.  area: sid, res_id, area of the whole chain (``workers.surface_area``)."""
    first = sites.groupBy("sid").agg(F.min(F.struct("site_idx", "x", "y", "z")).alias("p"), F.count(F.lit(1)).alias("n_metal_sites")).select("sid", "n_metal_sites", *(F.col(f"p.{c}").alias(f"s{c}") for c in "xyz"))
    held = canonical_donors(atoms, sites, donors, limit)
    r0 = F.coalesce(*(F.when(F.col("element") == e, r) for e, r in VALENCE_RADII.items()))
    counts = held.groupBy("sid").agg(
        F.count(F.lit(1)).alias("cn"), *(F.count_if(F.col("element") == e).alias(f"n_{e.lower()}") for e in "NOS"), F.sum(bond_valence(F.col("d"), r0)).alias("valence"), F.slice(F.array_sort(F.collect_list("d")), 1, 6).alias("nearest")
    )
    at = held.join(first.select("sid", "sx", "sy", "sz"), "sid")
    other = held.select("sid", F.col("idx").alias("j"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    angles = at.join(other, "sid").where("idx < j").select("sid", angle_degrees(point(), point("s"), point("b")).alias("a"))
    stats = angles.groupBy("sid").agg(F.avg("a").alias("angle_mean"), F.stddev_pop("a").alias("angle_std"), F.min("a").alias("angle_min"), F.max("a").alias("angle_max"), F.array_sort(F.collect_list("a")).alias("angles"))
    residues = held.select("sid", "res_id").distinct()
    canonical = F.lit(False)
    for name, names in donors.items():
        canonical = canonical | ((F.col("res_name") == name) & F.col("atom_name").isin(*names))
    polar = atoms.where(F.col("element").isin("N", "O")).join(residues.withColumn("__own", F.lit(True)), ["sid", "res_id"], "left").where(~(canonical & F.coalesce("__own", F.lit(False))))
    shell_ = range_join(polar.select("sid", "idx", "x", "y", "z"), held.select("sid", "x", "y", "z"), SECOND_SHELL).groupBy("sid").agg(F.count_distinct("idx").alias("second_shell"))
    exposed = area.join(residues, ["sid", "res_id"], "left_semi").groupBy("sid").agg(F.sum("area").alias("area"))
    u, v = (tuple(F.col(f"{k}.{c}") for c in "xyz") for k in "uv")
    two = sites.alias("u").join(sites.alias("v"), "sid").where("u.site_idx < v.site_idx").groupBy("sid").agg(F.min(distance(u, v)).alias("gap"))
    dev = lambda want: F.when(F.size("angles") == len(want), F.sqrt(F.aggregate(F.zip_with("angles", F.array(*(F.lit(w) for w in want)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, w: t + w) / len(want)))
    j = structures.select("sid")
    for side in (first, counts, stats, shell_, exposed, two):
        j = j.join(side, "sid", "left")
    metal, none = F.col("n_metal_sites").isNotNull(), F.lit(None).cast("double")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    made = {
        "coordination_number": n("cn"), **{f"donor_{e}": n(f"n_{e}") for e in "nos"}, **{f"distance_{k + 1}": F.try_element_at("nearest", F.lit(k + 1)) for k in range(6)},
        **{f"angle_{k}": F.col(f"angle_{k}") for k in ("mean", "std", "min", "max")}, **{f"deviation_{k}": dev(w) for k, w in IDEAL.items()},
        "valence_sum": n("valence"), "valence_deviation": F.abs(n("valence") - 2), "second_shell": F.when(n("cn") > 0, n("second_shell")), "area": n("area"),
        "site_gap": F.when(F.col("n_metal_sites") == 2, F.col("gap")).otherwise(none), "n_metal_sites": n("n_metal_sites"), "has_metal": F.lit(1.0),
    }
    return j.select("sid", *(F.when(metal, c).otherwise(0.0).alias(k) for k, c in made.items()))
