"""Surface area (caps in Arrow batches) and seeded controls (Catalyst expressions): SQL repeats them number by number.

Random numbers are counters: the first digits of a SHA-256 over seed, structure and row.  They depend on nothing but
these, so a lost task draws the same again, and rows need not be gathered to draw for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, point
from .spatial import range_join

#: Van der Waals radii by element (OTHER for all more), the probe's radius, and words of spots on a sphere.
RADII, OTHER, PROBE, WORDS, WORD = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}, 1.7, 1.4, 2, 48


def sphere(n: int = WORDS * WORD) -> list[tuple[float, float, float]]:
    """n spots spread evenly over the unit sphere (a golden spiral)."""
    out = []
    for k in range(n):
        z, turn = 1 - 2 * (k + 0.5) / n, math.pi * (1 + 5**0.5) * (k + 0.5)
        r = math.sqrt(1 - z * z)
        out.append((r * math.cos(turn), r * math.sin(turn), z))
    return out


def radius(element: Column) -> Column:
    """Of an atom with the probe."""
    return F.coalesce(*(F.when(element == e, r + PROBE) for e, r in RADII.items()), F.lit(OTHER + PROBE))


def _caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair's cap as masks, by the arithmetic of the SQL and in its order."""
    ux, uy, uz = (np.array(u)[None] for u in zip(*sphere(), strict=True))
    bits = np.int64(1) << np.arange(WORD, dtype=np.int64)
    for batch in batches:
        col = {c: batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in batch.schema.names[2:]}
        beyond = (col["d"] * col["d"] + col["r"] * col["r"] - col["r_r"] * col["r_r"]) / (2 * col["r"])
        hidden = (col["r_x"] - col["x"]) * ux + (col["r_y"] - col["y"]) * uy + (col["r_z"] - col["z"]) * uz > beyond
        words = [pa.array(hidden[:, w * WORD : (w + 1) * WORD] @ bits) for w in range(WORDS)]
        yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("idx"), *words], ["sid", "idx", *(f"w{w}" for w in range(WORDS))])


def surface_area(atoms: DataFrame) -> DataFrame:
    """GE29: sid, res_id, area (accessible area / 100), by rolling a probe over each atom's sphere.

    Neighbours come from a radius join.  A neighbour hides the spots of a cap: those whose direction u has
    u . (b - a) > (d^2 + ra^2 - rb^2) / (2 ra).  A cap is a mask of bits, the union of caps is a ``bit_or``, and the
    area follows from the count of bits.  Masks are made in Arrow batches: as expressions, one for each spot, they are a
    plan whose compilation takes more of the driver than the data does.  atoms: sid, idx, res_id, element, x, y, z."""
    own = atoms.select("sid", "idx", "res_id", radius(F.col("element")).alias("r"), "x", "y", "z")
    reach = 2 * (max(*RADII.values(), OTHER) + PROBE)
    near = range_join(own, own.drop("res_id"), reach).where((F.col("idx") != F.col("r_idx")) & (F.col("d") < F.col("r") + F.col("r_r")))
    caps = near.select("sid", "idx", "d", "r", "r_r", *(F.col(c) for c in "xyz"), *(F.col(f"r_{c}") for c in "xyz")).mapInArrow(_caps, f"sid {atoms.schema['sid'].dataType.simpleString()}, idx {atoms.schema['idx'].dataType.simpleString()}, " + ", ".join(f"w{w} long" for w in range(WORDS)))
    caps = caps.groupBy("sid", "idx").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))
    hidden = sum((F.bit_count(F.coalesce(f"w{w}", F.lit(0))) for w in range(1, WORDS)), F.bit_count(F.coalesce("w0", F.lit(0))))
    free = 1 - hidden / (WORDS * WORD)
    area = 4 * math.pi * F.col("r") * F.col("r") * free / 100
    return own.join(caps, ["sid", "idx"], "left").groupBy("sid", "res_id").agg(F.sum(area).alias("area"))


def uniform(seed: int, stream: str, *keys: str) -> Column:
    """A number from 0 to 1 of these keys; another stream, another number."""
    digest = F.sha2(F.concat_ws(":", F.lit(f"{seed}{stream}"), *keys), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def permute_coordinates(atoms: DataFrame, seed: int) -> DataFrame:
    """MT17: a structure's coordinates dealt anew over its donors: the donor that is k-th by idx gets those of the one
    that is k-th by its random number."""
    by = Window.partitionBy("sid")
    ranked = atoms.withColumn("__u", uniform(seed, "p", "sid", "idx"))
    own = ranked.drop("x", "y", "z").withColumn("__k", F.row_number().over(by.orderBy("idx"))).drop("__u")
    dealt = ranked.select("sid", "x", "y", "z", F.row_number().over(by.orderBy("__u", "idx")).alias("__k"))
    return own.join(dealt, ["sid", "__k"]).select(*atoms.columns)


def scramble_directions(bonds: DataFrame, seed: int) -> DataFrame:
    """MT18: each donor moved to a random direction from its metal, at the same distance.  All directions are alike:
    the height and the turn about the axis are uniform.  bonds: sid, idx, x, y, z (donor) and mx, my, mz (metal)."""
    z, turn = 1 - 2 * uniform(seed, "z", "sid", "idx"), 2 * math.pi * uniform(seed, "t", "sid", "idx")
    rows = bonds.withColumns({"__z": z, "__t": turn, "__l": distance(point(), point("m"))})
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("__z") * F.col("__z")))
    to = {"x": F.col("mx") + F.col("__l") * flat * F.cos("__t"), "y": F.col("my") + F.col("__l") * flat * F.sin("__t"), "z": F.col("mz") + F.col("__l") * F.col("__z")}
    return rows.withColumns(to).select(*bonds.columns)
