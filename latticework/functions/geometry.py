"""Geometry as Catalyst expressions; only the rotations of ``with_superposition`` leave the JVM, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Point = tuple[Column, Column, Column]


def point(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Point:
    return tuple(F.col(f"{prefix}{n}") for n in names)  # type: ignore[return-value]


def distance(a: Point, b: Point) -> Column:
    """Euclidean distance of two points in space."""
    dx, dy, dz = (p - q for p, q in zip(a, b, strict=True))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def distance_n(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of one length."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def angle_degrees(a: Point, centre: Point, b: Point) -> Column:
    """Angle at ``centre``, in degrees; the tiny denominator keeps coinciding points defined."""
    u, v = minus(a, centre), minus(b, centre)
    cosine = dot(u, v) / (norm(u) * norm(v) + F.lit(1e-8))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def with_torsion(df, name: str, a: Point, b: Point, c: Point, d: Point):
    """Add the signed torsion about b-c, in radians; vectors are columns of steps of their own, which keeps
    the generated code small."""
    sides = {f"__{k}{x}": v for k, (p, q) in {"u": (a, b), "v": (b, c), "w": (c, d)}.items() for x, v in zip("xyz", minus(q, p), strict=True)}
    df = df.withColumns(sides)
    u, v, w = (point(f"__{k}") for k in "uvw")
    df = df.withColumns({f"__{k}{x}": e for k, n in (("m", cross(u, v)), ("n", cross(v, w))) for x, e in zip("xyz", n, strict=True)})
    m, n = point("__m"), point("__n")
    df = df.withColumns({"__s": norm(v) * dot(u, n), "__c": dot(m, n)})
    return df.withColumn(name, F.atan2("__s", "__c")).drop(*(c for c in df.columns if c.startswith("__")))


def covariance(xs: Sequence[Point], ys: Sequence[tuple[float, float, float]]) -> dict[str, Column]:
    """Sums that decide the best superposition of moving points on fixed ones: h00..h22 and e = |X|^2 + |Y|^2,
    both sets centred."""
    n = len(xs)
    centre = [sum((p[k] for p in xs[1:]), xs[0][k]) / n for k in range(3)]
    fixed = [[p[k] - sum(q[k] for q in ys) / n for k in range(3)] for p in ys]
    out = {}
    for i in range(3):
        for j in range(3):
            out[f"h{i}{j}"] = sum(((p[i] - centre[i]) * F.lit(q[j]) for p, q in zip(xs[1:], fixed[1:], strict=True)), (xs[0][i] - centre[i]) * F.lit(fixed[0][j]))
    own = sum(((p[k] - centre[k]) * (p[k] - centre[k]) for p in xs for k in range(3)), F.lit(0.0))
    out["e"] = own + F.lit(sum(v * v for p in fixed for v in p))
    return out


def superposition_rmsd(n: int) -> dict[str, Column]:
    """Steps from the columns of ``covariance`` to the error of the best proper rotation, as two dictionaries'
    worth of columns in order: the eigenvalues of H'H in closed form give the singular values of H.

    Apply with ``with_steps``: each step is its own projection, which keeps the expression small.
    """
    h = {f"h{i}{j}": F.col(f"h{i}{j}") for i in range(3) for j in range(3)}
    steps: dict[str, Column] = {}
    for i in range(3):
        for j in range(i, 3):
            steps[f"m{i}{j}"] = sum((h[f"h{k}{i}"] * h[f"h{k}{j}"] for k in (1, 2)), h[f"h0{i}"] * h[f"h0{j}"])
    steps["det"] = (
        h["h00"] * (h["h11"] * h["h22"] - h["h12"] * h["h21"]) - h["h01"] * (h["h10"] * h["h22"] - h["h12"] * h["h20"]) + h["h02"] * (h["h10"] * h["h21"] - h["h11"] * h["h20"])
    )
    return steps


def with_rmsd(df, n: int, name: str = "rmsd"):
    """Add the superposition error to a DataFrame with the columns of ``covariance``; those columns go."""
    keep = [c for c in df.columns if c != "e" and not (len(c) == 3 and c[0] == "h" and c[1:].isdigit())]
    m = {k: F.col(k) for k in ("m00", "m01", "m02", "m11", "m12", "m22")}
    q = (F.col("m00") + F.col("m11") + F.col("m22")) / 3
    a = df.select(*keep, "e", *(v.alias(k) for k, v in superposition_rmsd(n).items()))
    a = a.withColumn("q", q).withColumn(
        "p",
        F.sqrt(
            ((m["m00"] - F.col("q")) * (m["m00"] - F.col("q")) + (m["m11"] - F.col("q")) * (m["m11"] - F.col("q")) + (m["m22"] - F.col("q")) * (m["m22"] - F.col("q"))
             + 2 * (m["m01"] * m["m01"] + m["m02"] * m["m02"] + m["m12"] * m["m12"])) / 6
        ),
    )
    b = {k: ((m[k] - F.col("q")) if k in ("m00", "m11", "m22") else m[k]) / F.col("p") for k in m}
    half = (
        b["m00"] * (b["m11"] * b["m22"] - b["m12"] * b["m12"]) - b["m01"] * (b["m01"] * b["m22"] - b["m12"] * b["m02"]) + b["m02"] * (b["m01"] * b["m12"] - b["m11"] * b["m02"])
    ) / 2
    a = a.withColumn("r", F.when(F.col("p") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))).otherwise(1.0)).withColumn("phi", F.acos("r") / 3)
    third = F.lit(2.0943951023931953)
    a = a.withColumn("e1", F.col("q") + 2 * F.col("p") * F.cos("phi")).withColumn("e3", F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + third))
    a = a.withColumn("e2", 3 * F.col("q") - F.col("e1") - F.col("e3"))
    s = [F.sqrt(F.greatest(F.col(k), F.lit(0.0))) for k in ("e1", "e2", "e3")]
    trace = s[0] + s[1] + F.when(F.col("det") < 0, -s[2]).otherwise(s[2])
    return a.select(*keep, F.sqrt(F.greatest((F.col("e") - 2 * trace) / n, F.lit(0.0))).alias(name))


def with_superposition(df: DataFrame, fixed: Sequence[tuple[float, float, float]], target: str = "target") -> DataFrame:
    """Add ``rotation`` (nine numbers, row by row) and ``translation`` (three): the rigid motion, without a
    reflection, that brings the fixed points nearest to ``target``, an array of as many points in one row of numbers.
    Rows must have a target; each Arrow batch is one stacked decomposition."""
    points = np.array(fixed, float)
    centre, count = points.mean(axis=0), len(points)
    ours = points - centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            theirs = b.column(target).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, count, 3)
            middle = theirs.mean(axis=1)
            left, _, right = np.linalg.svd(np.einsum("ni,bnj->bij", ours, theirs - middle[:, None]))
            left[:, :, 2] *= np.sign(np.linalg.det(left @ right))[:, None]
            turn = left @ right
            move = middle - centre @ turn
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * w), pa.array(v.reshape(-1))) for v, w in ((turn, 9), (move, 3))]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "rotation", "translation"])

    numbers = T.ArrayType(T.DoubleType())
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("rotation", numbers), T.StructField("translation", numbers)]))


def moved(p: Point, rotation: Column, translation: Column) -> Point:
    """A point after the rigid motion of ``with_superposition``."""
    return tuple(p[0] * rotation[k] + p[1] * rotation[3 + k] + p[2] * rotation[6 + k] + translation[k] for k in range(3))  # type: ignore[return-value]


def bond_valence(d: Column, r0: Column) -> Column:
    return F.exp((r0 - d) / 0.37)
