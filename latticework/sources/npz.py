"""SC4, SC5 and SK2: NumPy archives (parallel arrays and JSON metadata), one file or one Parquet row a record."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, metadata string, n_atoms int, metal_coords array<array<double>>, metal_probabilities array<double>, coords array<array<double>>, res_ids array<int>, atom_names array<string>, res_names array<string>, elements array<string>"
#: SC5: the arrays of a template's archive beside its metadata.
TEMPLATE_ARRAYS = {
    "metal_coords": "array<array<double>>", "donor_coords": "array<array<double>>", "donor_elements": "array<string>", "donor_site_indices": "array<int>",
    "donor_labels": "array<string>", "ligand_coords": "array<array<double>>", "ligand_elements": "array<string>", "ligand_atom_names": "array<string>",
}
TEMPLATE_SCHEMA = "path string, metadata string, " + ", ".join(f"{k} {v}" for k, v in TEMPLATE_ARRAYS.items())


def decode(path: str, content: bytes) -> dict:
    """A legacy single metal becomes a list of one site, with the metadata's confidence or 0.7."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        meta = json.loads(str(z["metadata"])) if "metadata" in z else {}
        metals, p = None, None
        if "metal_coords" in z and z["metal_coords"].size:
            metals, p = z["metal_coords"].reshape(-1, 3).tolist(), z["metal_probabilities"].tolist() if "metal_probabilities" in z else None
        elif "metal_coord" in z and z["metal_coord"].size:
            metals, p = [z["metal_coord"].reshape(3).tolist()], [float(meta.get("metal_confidence") or 0.7)]
        get = lambda k, default: z[k].tolist() if k in z else default
        coords = get("coords", [])
        return {"path": path, "metadata": json.dumps(meta, sort_keys=True), "n_atoms": len(coords), "metal_coords": metals, "metal_probabilities": p, "coords": coords, "res_ids": get("res_ids", []), "atom_names": get("atom_names", []), "res_names": get("res_names", []), "elements": get("elements", [])}


def decode_template(path: str, content: bytes) -> dict:
    """SC5: all eight arrays have to be there."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        return {"path": path, "metadata": json.dumps(json.loads(str(z["metadata_json"])), sort_keys=True), **{k: z[k].tolist() for k in TEMPLATE_ARRAYS}}


def encode(record: dict, meta: str = "metadata") -> bytes:
    """One compressed archive of metadata (JSON, under the name ``meta``) and the arrays that are not null."""
    out = io.BytesIO()
    np.savez_compressed(out, **{meta: np.array(record["metadata"] or "{}")}, **{k: np.array(_plain(v)) for k, v in record.items() if k != "metadata" and v is not None})
    return out.getvalue()


def _plain(v) -> list:
    return [_plain(x) if isinstance(x, (np.ndarray, list)) else x for x in v]


def archives(records: DataFrame, meta: str = "metadata") -> DataFrame:
    """SK2: path, content (the archive) for rows of path, metadata and arrays; write them as Parquet.  A template's
    metadata is named ``metadata_json``."""
    arrays = [c for c in records.columns if c != "path"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [encode(r, meta) for r in f[arrays].to_dict("records")]})

    return records.mapInPandas(run, "path string, content binary")


def unpack(contents: DataFrame) -> DataFrame:
    """The records of path and content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([decode(p, c) for p, c in zip(f["path"], f["content"], strict=True)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return contents.select("path", "content").mapInPandas(run, SCHEMA)


def unpack_templates(contents: DataFrame) -> DataFrame:
    """The templates of path and content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([decode_template(p, c) for p, c in zip(f["path"], f["content"], strict=True)], columns=["path", "metadata", *TEMPLATE_ARRAYS])

    return contents.select("path", "content").mapInPandas(run, TEMPLATE_SCHEMA)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    return unpack(spark.read.format("binaryFile").load(path))
