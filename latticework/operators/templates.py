"""GE39: templates of a bound ligand, its metals and their donors, cut out of structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, point
from .motif import DONORS

#: How near ligand and metal, and donor and metal, have to be; least donors and heavy ligand atoms.
LIGAND_REACH, DONOR_REACH, MIN_DONORS, MIN_HEAVY = 4.0, 2.9, 3, 8


def n_sites(subclass):  # noqa: ANN001, ANN201
    """One metal in subclass B2, else two."""
    return F.when(subclass == "B2", 1).otherwise(2)


def extract(atoms: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per spec: its columns, ``fault`` (null where there is a template) and the eight arrays of a template
    (null where there is none), atoms in the order of their lines.

    The ligand is the copy nearest any zinc of the chain (of equals, the first); its metals are the one or two zincs
    nearest to it.  atoms: as ``parse_pdb`` gives them, with ``id``; specs: id, protein_chain, ligand_resname, subclass."""
    spec = specs.select("id", "protein_chain", "ligand_resname", n_sites(F.col("subclass")).alias("want"))
    own = atoms.join(spec, "id").where(F.col("chain_id") == F.col("protein_chain"))
    group = F.struct("res_id", "ins_code")
    ligands = own.where(F.col("hetero") & (F.col("res_name") == F.col("ligand_resname"))).select("id", group.alias("copy"), "line", "atom_name", "element", "x", "y", "z")
    zinc = own.where(F.col("hetero") & (F.col("element") == "ZN")).select("id", F.col("line").alias("zline"), "want", *(F.col(c).alias(f"z{c}") for c in "xyz"))
    apart = ligands.join(zinc, "id").withColumn("d", distance(point(), point("z")))
    copies = apart.groupBy("id", "copy").agg(F.min("d").alias("d"), F.min("line").alias("first"))
    ligand = copies.groupBy("id").agg(F.min_by("copy", F.struct("d", "first")).alias("copy"))
    near = apart.join(ligand, ["id", "copy"]).groupBy("id", "zline", "want", "zx", "zy", "zz").agg(F.min("d").alias("d"))
    ranked = near.withColumn("site", F.row_number().over(Window.partitionBy("id").orderBy("d", "zline")) - 1).where(F.col("site") < F.col("want"))
    at = lambda p="": F.array(*point(p))
    in_order = lambda rows, order: F.array_sort(F.collect_list(F.struct(order, *rows)))
    metals = ranked.groupBy("id").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n_metals"), in_order([at("z").alias("at")], "site").alias("m"))
    heavy = ligands.join(ligand, ["id", "copy"]).where(~F.col("element").isin("H", "D"))
    bound = heavy.groupBy("id").agg(in_order([at().alias("at"), "element", "atom_name"], "line").alias("l"))
    canonical = F.lit(False)
    for residue, names in DONORS.items():
        canonical = canonical | ((F.col("res_name") == residue) & F.col("atom_name").isin(*names))
    close = own.where(~F.col("hetero") & canonical).join(ranked.select("id", "site", "zx", "zy", "zz"), "id").withColumn("d", distance(point(), point("z")))
    label = F.concat("res_name", F.lit(":"), F.col("res_id").cast("string"), F.coalesce("ins_code", F.lit("")), F.lit(":"), "atom_name")
    nearest = close.groupBy("id", "line", "element", label.alias("label"), "x", "y", "z").agg(F.min(F.struct("d", "site")).alias("n")).where(F.col("n.d") <= DONOR_REACH)
    donors = nearest.groupBy("id").agg(in_order([at().alias("at"), "element", F.col("n.site").alias("site"), "label"], "line").alias("o"), F.count_distinct("n.site").alias("served"))
    has = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    j = specs.withColumn("__want", n_sites(F.col("subclass")))
    for side in (has(ligands, "__ligand"), has(zinc, "__zinc"), metals, bound, donors):
        j = j.join(side, "id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    fault = (
        F.when(F.col("__ligand").isNull(), "no ligand").when(F.col("__zinc").isNull(), "no zinc").when(F.col("n_metals") < F.col("__want"), "too few zincs").when(F.col("d") > LIGAND_REACH, "ligand away from the metals")
        .when(size("o") < MIN_DONORS, "too few donors").when(F.col("served") < F.col("__want"), "a zinc without a donor").when(size("l") < MIN_HEAVY, "too few heavy atoms")
    )
    part = lambda c, f: F.when(F.col("fault").isNull(), F.transform(c, lambda s: s[f]))
    return j.withColumn("fault", fault).select(
        *specs.columns, "fault", part("m", "at").alias("metal_coords"), part("o", "at").alias("donor_coords"), part("o", "element").alias("donor_elements"), part("o", "site").alias("donor_site_indices"),
        part("o", "label").alias("donor_labels"), part("l", "at").alias("ligand_coords"), part("l", "element").alias("ligand_elements"), part("l", "atom_name").alias("ligand_atom_names"),
    )
