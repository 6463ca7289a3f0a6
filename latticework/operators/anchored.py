"""Templates anchored at a metal: the metal and its donors are superposed together.

GE14 enumerates sites and, inside a site, one donor for each template donor of its element; GE15 keeps the least
error and gives the status; GE16 combines templates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import covariance, point, with_rmsd

MAX_ASSIGNMENTS = 100_000


@dataclass(frozen=True)
class Anchored:
    """A metal at the origin and donors as (element, x, y, z)."""

    name: str
    donors: tuple[tuple[str, float, float, float], ...]


EXAMPLES = (
    Anchored("short", (("N", 2.0, 0.0, 0.0), ("O", 0.0, 2.0, 0.0), ("S", 0.0, 0.0, 2.3))),
    Anchored("wide", (("N", 3.0, 0.0, 0.0), ("O", 0.0, 3.0, 0.0), ("S", -2.0, 0.0, 2.5))),
)


def assignments(donors: DataFrame, sites: DataFrame, t: Anchored) -> DataFrame:
    """GE14: every choice of distinct donors of the right elements at each site.  donors: with GE5's columns."""
    out = sites.select("sid", "site_idx", *(F.col(c).alias(f"m{c}") for c in "xyz"))
    for k, (element, *_) in enumerate(t.donors):
        d = donors.where(F.col("element") == element).select("sid", "site_idx", F.col("idx").alias(f"i{k}"), *(F.col(c).alias(f"d{k}{c}") for c in "xyz"))
        out = out.join(d, ["sid", "site_idx"])
        for j in range(k):
            if t.donors[j][0] == element:
                out = out.where(F.col(f"i{k}") != F.col(f"i{j}"))
    return out


def score(structures: DataFrame, donors: DataFrame, sites: DataFrame, t: Anchored, max_rmsd: float = 1.25, cap: int = MAX_ASSIGNMENTS) -> DataFrame:
    """GE15: sid, template, status, n_assignments, rmsd.  Without a site: unavailable; without an assignment:
    not_applicable; beyond the cap, an error."""
    found = assignments(donors, sites, t)
    n = len(t.donors)
    h = covariance([point("m"), *(point(f"d{k}") for k in range(n))], [(0.0, 0.0, 0.0), *(d[1:] for d in t.donors)])
    best = with_rmsd(found.select("sid", *(v.alias(k) for k, v in h.items())), n + 1).groupBy("sid").agg(F.min("rmsd").alias("rmsd"), F.count(F.lit(1)).alias("n"))
    has = sites.select("sid").distinct().withColumn("has", F.lit(True))
    j = structures.select("sid").join(has, "sid", "left").join(best, "sid", "left")
    capped = F.when(F.coalesce("n", F.lit(0)) <= cap, F.coalesce("n", F.lit(0))).otherwise(F.raise_error(F.lit("too many assignments")).cast("long"))
    status = F.when(F.col("has").isNull(), "unavailable").when(F.col("n").isNull(), "not_applicable").when(F.col("rmsd") <= max_rmsd, "supported").otherwise("not_supported")
    return j.select("sid", F.lit(t.name).alias("template"), status.alias("status"), capped.alias("n_assignments"), "rmsd")


def combine(scores: DataFrame) -> DataFrame:
    """GE16: supported if any template is; the best is the least error among the supported, else among all that
    could be evaluated."""
    yes, can = F.col("status") == "supported", F.col("rmsd").isNotNull()
    pick = lambda c: F.coalesce(F.min_by(c, F.when(yes, F.struct("rmsd", "template"))), F.min_by(c, F.when(can, F.struct("rmsd", "template"))))
    return scores.groupBy("sid").agg(F.bool_or(yes).alias("supported"), F.count_if(can).alias("n_evaluable"), F.count_if(yes).alias("n_supported"), pick("template").alias("best"), pick("rmsd").alias("rmsd"))
