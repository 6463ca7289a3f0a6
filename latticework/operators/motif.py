"""Six-donor motif search: donor roles, triads, pairs of triads and their superposition on a template.

Every step is an equi-join on the structure with a distance predicate; the closed-form superposition error
keeps the whole search in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import covariance, distance, moved, point, with_rmsd, with_superposition
from .spatial import pose_metrics

#: Donor atoms of each residue, and modified cysteines.
DONORS = {"HIS": ("ND1", "NE2"), "ASP": ("OD1", "OD2"), "GLU": ("OE1", "OE2"), "CYS": ("SG",)}
MODIFIED_CYSTEINES = ("CSD", "CSO", "OCS")
#: Gates: superposition error, clash share, contact share; cap on alignments of a structure.
MAX_RMSD, MAX_CLASH, MIN_CONTACT, MAX_ALIGNMENTS = 1.25, 0.10, 0.50, 250_000


@dataclass(frozen=True)
class Template:
    """Six points: an (O, S, N) site, then an (N, N, N) site; both are matched within ``tolerance``.  The heavy
    atoms of the ligand and the metals are carried over to the structures."""

    first: tuple[tuple[float, float, float], ...]
    second: tuple[tuple[float, float, float], ...]
    tolerance: float = 0.75
    centroid_tolerance: float = 2.5
    ligand: tuple[tuple[float, float, float], ...] = ()
    metals: tuple[tuple[float, float, float], ...] = ()

    @staticmethod
    def sides(p: tuple[tuple[float, float, float], ...]) -> list[float]:
        d = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True)) ** 0.5
        return [d(p[0], p[1]), d(p[0], p[2]), d(p[1], p[2])]

    def gap(self) -> float:
        c = [[sum(p[k] for p in s) / 3 for k in range(3)] for s in (self.first, self.second)]
        return sum((u - v) ** 2 for u, v in zip(*c, strict=True)) ** 0.5


EXAMPLE = Template(
    ((0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (2.0, 3.4641016151377544, 0.0)),
    ((0.0, 0.0, 5.0), (4.0, 0.0, 5.0), (2.0, 3.4641016151377544, 5.0)),
    ligand=((2.0, 1.0, 1.0), (2.0, 1.0, 2.5), (2.0, 1.0, 4.0), (3.25, 1.0, 2.5)),
    metals=((2.0, 1.0, 0.0), (2.0, 1.0, 5.0)),
)


def donor_roles(atoms: DataFrame) -> DataFrame:
    """FI2: HIS ND1/NE2, ASP OD1/OD2 and the sulfur of cysteines get a role; others go.  Adds ``modified``."""
    name = lambda res: F.col("atom_name").isin(*DONORS[res])
    modified = F.col("res_name").isin(*MODIFIED_CYSTEINES)
    role = F.when((F.col("res_name") == "HIS") & name("HIS"), "HIS_N").when((F.col("res_name") == "ASP") & name("ASP"), "ASP_O").when(((F.col("res_name") == "CYS") | modified) & name("CYS"), "CYS_S")
    return atoms.withColumn("role", role).withColumn("modified", modified).where("role is not null")


def _named(atoms: DataFrame, role: str, to: str) -> DataFrame:
    at = atoms.where(F.col("role") == role)
    extra = [F.col("modified").alias(f"{to}mod")] if role == "CYS_S" and "modified" in atoms.columns else []
    return at.select("sid", F.col("idx").alias(f"{to}i"), F.col("res").alias(f"{to}r"), *(F.col(c).alias(f"{to}{c}") for c in "xyz"), *extra)


def mixed_triads(atoms: DataFrame, t: Template) -> DataFrame:
    """GE3: acid oxygen x cysteine sulfur x histidine nitrogen of three residues whose sides, in this order,
    are the template's within the tolerance; ``odev`` is the greatest deviation of a side.
    atoms: sid, idx, res, role, x, y, z."""
    os_, on, sn = t.sides(t.first)
    o, s, n = (_named(atoms, r, k) for r, k in (("ASP_O", "o"), ("CYS_S", "s"), ("HIS_N", "n")))
    d = lambda a, b: distance(point(a), point(b))
    near = lambda v, want: F.abs(v - want) <= t.tolerance
    two = o.join(s, "sid").where(near(d("o", "s"), os_) & (F.col("or") != F.col("sr")))
    three = two.join(n, "sid").where(near(d("o", "n"), on) & near(d("s", "n"), sn) & (F.col("or") != F.col("nr")) & (F.col("sr") != F.col("nr")))
    return three.withColumn("odev", F.greatest(*(F.abs(d(a, b) - want) for a, b, want in (("o", "s", os_), ("o", "n", on), ("s", "n", sn)))))


def histidine_triads(atoms: DataFrame, t: Template) -> DataFrame:
    """GE4: three histidine nitrogens of three residues, a < b < c; sorted sides against sorted sides, ``adev`` is the
    greatest deviation."""
    want = sorted(t.sides(t.second))
    a, b, c = (_named(atoms, "HIS_N", k) for k in "abc")
    d = lambda p, q: distance(point(p), point(q))
    near = (d("a", "b") >= want[0] - t.tolerance) & (d("a", "b") <= want[2] + t.tolerance)
    two = a.join(b, "sid").where((F.col("ai") < F.col("bi")) & (F.col("ar") != F.col("br")) & near)
    three = two.join(c, "sid").where((F.col("bi") < F.col("ci")) & (F.col("cr") != F.col("ar")) & (F.col("cr") != F.col("br")))
    sides = F.array_sort(F.array(d("a", "b"), d("a", "c"), d("b", "c")))
    dev = F.greatest(*(F.abs(sides[k] - want[k]) for k in range(3)))
    return three.where(dev <= t.tolerance).withColumn("adev", dev)


def triad_pairs(mixed: DataFrame, histidines: DataFrame, t: Template) -> DataFrame:
    """GE6: triads without a common residue whose centroids are as far apart as the template's."""
    centre = lambda ks: tuple(sum((F.col(f"{k}{c}") for k in ks[1:]), F.col(f"{ks[0]}{c}")) / 3 for c in "xyz")
    apart = ~F.array(F.col("or"), F.col("sr"), F.col("nr")).isNull()
    for p in "osn":
        for q in "abc":
            apart = apart & (F.col(f"{p}r") != F.col(f"{q}r"))
    gap = distance(centre("osn"), centre("abc"))
    return mixed.join(histidines, "sid").where(apart & (F.abs(gap - t.gap()) <= t.centroid_tolerance))


def alignments(pairs: DataFrame, t: Template) -> DataFrame:
    """GE7 and GE8: each pair in the six orders of its histidines, with the error of its superposition, the
    deviation of its sides (``dev``) and its six points (``target``)."""
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    atom = [F.struct(*(F.col(f"{k}{c}").alias(c) for c in ("i", "x", "y", "z"))) for k in "abc"]
    choices = F.array(*(F.struct(F.lit(n).alias("perm"), *(atom[o].alias(k) for k, o in zip("abc", p, strict=True))) for n, p in enumerate(orders)))
    extra = ["smod"] if "smod" in pairs.columns else []
    dev = F.greatest("odev", "adev").alias("dev")
    rows = pairs.select("sid", *(f"{k}{c}" for k in "osn" for c in ("i", "x", "y", "z")), *extra, dev, F.explode(choices).alias("c"))
    xs = [point(k) for k in "osn"] + [tuple(F.col(f"c.{k}.{c}") for c in "xyz") for k in "abc"]
    h = covariance(xs, [*t.first, *t.second])
    target = F.array(*(c for p in xs for c in p)).alias("target")
    rows = rows.select("sid", "oi", "si", "ni", *extra, "dev", target, F.col("c.perm").alias("perm"), *(F.col(f"c.{k}.i").alias(f"{k}i") for k in "abc"), *(v.alias(k) for k, v in h.items()))
    return with_rmsd(rows, 6)


#: The order of alignments of one structure; the first of equals wins.
ORDER = ("rmsd", "oi", "si", "ni", "ai", "bi", "ci", "perm")


def placements(fits: DataFrame, protein: DataFrame, t: Template, max_rmsd: float = MAX_RMSD, max_clash: float = MAX_CLASH, min_contact: float = MIN_CONTACT) -> DataFrame:
    """The alignments that can decide a structure, with the template moved onto them: rotation, translation, the
    pose metrics of the ligand and ``passes`` (all three gates).  These are the alignments within ``max_rmsd`` and the
    best one of each structure; all others fail a gate and rank behind it, so their poses are never needed.
    protein: sid, x, y, z of heavy atoms."""
    if not t.ligand:
        raise ValueError("a template without ligand atoms has no pose")
    by = Window.partitionBy("sid").orderBy(*ORDER)
    near = fits.withColumn("place", F.row_number().over(by)).where((F.col("place") == 1) | (F.col("rmsd") <= max_rmsd))
    placed = with_superposition(near, [*t.first, *t.second]).drop("target")
    atoms = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, "xyz", strict=True))) for p in t.ligand))
    ligand = placed.select("*", F.posexplode(atoms).alias("lig", "l"))
    at = moved(tuple(F.col(f"l.{c}") for c in "xyz"), F.col("rotation"), F.col("translation"))
    ligand = ligand.withColumns(dict(zip("xyz", at, strict=True))).drop("l")
    pose = pose_metrics(ligand, protein, "place", carry=tuple(c for c in placed.columns if c not in ("sid", "place")))
    gates = (F.col("rmsd") <= max_rmsd) & (F.col("clash_share") <= max_clash) & (F.col("contact_share") >= min_contact)
    return pose.withColumn("passes", gates)


def search(atoms: DataFrame, t: Template = EXAMPLE, max_rmsd: float = MAX_RMSD, cap: int = MAX_ALIGNMENTS, protein: DataFrame | None = None, max_clash: float = MAX_CLASH, min_contact: float = MIN_CONTACT) -> DataFrame:
    """GE12: one row per structure: counts of donors, triads and alignments; error, mapping, pose and carried metals
    of the best alignment (one that passes all gates before one that does not, then the lesser error), and the calls:
    of the architecture (error alone), of the full pose (all gates), and both without modified cysteines.  A structure
    beyond the cap is ``unavailable`` whatever was found.  ``protein``: all heavy atoms (default: the donors)."""
    mixed, his = mixed_triads(atoms, t), histidine_triads(atoms, t)
    pairs = triad_pairs(mixed, his, t)
    counts = pairs.groupBy("sid").agg((F.count(F.lit(1)) * 6).alias("n_alignments"))
    # The number of alignments is known before any is built, so structures beyond the cap cost nothing more.
    fine = pairs.join(counts.where(F.col("n_alignments") <= cap).select("sid"), "sid", "left_semi")
    posed = placements(alignments(fine, t), atoms if protein is None else protein, t, max_rmsd, max_clash, min_contact)
    metals = F.array(*(F.array(*(F.round(c, 4) for c in moved(tuple(F.lit(v) for v in p), F.col("rotation"), F.col("translation")))) for p in t.metals))
    modified = F.col("smod") if "smod" in posed.columns else F.lit(False)
    shown = F.struct("rmsd", F.concat_ws("-", "oi", "si", "ni", "ai", "bi", "ci").alias("mapping"), "clash_share", "contact_share", "min_distance", "passes", modified.alias("modified"), metals.alias("metals"))
    best = posed.groupBy("sid").agg(F.min_by(shown, F.struct(~F.col("passes"), *ORDER)).alias("best")).select("sid", "best.*")
    base = atoms.groupBy("sid").agg(F.count(F.lit(1)).alias("n_donors"))
    out = base.join(mixed.groupBy("sid").agg(F.count(F.lit(1)).alias("n_mixed")), "sid", "left").join(his.groupBy("sid").agg(F.count(F.lit(1)).alias("n_his")), "sid", "left")
    out = out.join(counts, "sid", "left").join(best, "sid", "left").fillna(0, ["n_mixed", "n_his", "n_alignments"])
    no = lambda c: F.coalesce(c, F.lit(False))
    call, full, native = no(F.col("rmsd") <= max_rmsd), no(F.col("passes")), ~no(F.col("modified"))
    status = F.when(F.col("n_alignments") > cap, "unavailable").when(full, "supported").otherwise("not_supported")
    return out.select(
        "sid", "n_donors", "n_mixed", "n_his", "n_alignments", "rmsd", "mapping", "clash_share", "contact_share", "min_distance", "metals",
        call.alias("architecture_call"), full.alias("full_pose_call"), (call & native).alias("native_architecture_call"), (full & native).alias("native_full_pose_call"), status.alias("status"),
    )


def least_tolerance(atoms: DataFrame, t: Template, protein: DataFrame | None = None, max_rmsd: float = MAX_RMSD, max_clash: float = MAX_CLASH, min_contact: float = MIN_CONTACT) -> DataFrame:
    """MT13: sid and the least tolerance of pair distances (up to the template's) at which the structure passes all
    gates; structures that never do are absent.  One pass of scoring serves every tolerance of a sweep."""
    fits = alignments(triad_pairs(mixed_triads(atoms, t), histidine_triads(atoms, t), t), t)
    posed = placements(fits, atoms if protein is None else protein, t, max_rmsd, max_clash, min_contact)
    return posed.where("passes").groupBy("sid").agg(F.min("dev").alias("tolerance"))


def inventory(atoms: DataFrame) -> DataFrame:
    """MT15: at least four histidine, one acid and one cysteine residues."""
    n = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("res")))
    counted = atoms.groupBy("sid").agg(n("HIS_N").alias("n_his_res"), n("ASP_O").alias("n_asp_res"), n("CYS_S").alias("n_cys_res"))
    return counted.withColumn("complete", (F.col("n_his_res") >= 4) & (F.col("n_asp_res") >= 1) & (F.col("n_cys_res") >= 1))
