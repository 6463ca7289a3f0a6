"""Template extraction and pocket files as round trips through archives and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import templates
from ..operators.motif import DONORS
from ..plans.views import ATOM_SQL, SITE_SQL, STRUCT_SQL, atoms, sites, structures
from ..sources import npz, pdb_source, sinks
from .spatial import D

#: First atom of the stand-in ligand, and how far its second copy lies.
FIRST, SHIFT = 12, 30.0


def bound_atoms(spark, d):
    """Stand-in structures with a ligand in two copies and zincs; the coordinates are halved, so that donors are near."""
    a = atoms(spark, d).select("sid", "idx", "res_id", "atom_name", "res_name", "element", "chain_id", *((F.col(c) / 2).alias(c) for c in "xyz"))
    bound = F.col("idx") >= FIRST
    element = F.when(bound & (F.col("idx") >= 19) & (F.col("sid") % 13 == 0), "H").otherwise(F.col("element"))
    one = a.select("sid", (F.col("idx") + 1).alias("line"), bound.alias("hetero"), "atom_name", F.when(bound, "LIG").otherwise(F.col("res_name")).alias("res_name"), F.when(bound, 800).otherwise(F.col("res_id")).alias("res_id"), "chain_id", element.alias("element"), *"xyz")
    two = one.where("hetero").select("sid", (F.col("line") + 50).alias("line"), "hetero", "atom_name", "res_name", F.lit(801).alias("res_id"), "chain_id", "element", (F.col("x") + F.when(F.col("sid") % 2 == 0, SHIFT).otherwise(0.5)).alias("x"), "y", "z")
    zinc = sites(spark, d).select("sid", (100 + F.col("site_idx")).alias("line"), F.lit(True).alias("hetero"), F.lit("ZN").alias("atom_name"), F.lit("ZN").alias("res_name"), (900 + F.col("site_idx")).alias("res_id"), F.lit("A").alias("chain_id"), F.lit("ZN").alias("element"), *((F.col(c) / 2).alias(c) for c in "xyz"))
    return one.unionByName(two).unionByName(zinc).select(F.col("sid").alias("id"), "line", "hetero", "atom_name", "res_name", "res_id", F.lit("").alias("ins_code"), "chain_id", "element", *"xyz")


BOUND_SQL = f"""one AS (SELECT sid, idx + 1 AS line, idx >= {FIRST} AS hetero, atom_name, CASE WHEN idx >= {FIRST} THEN 'LIG' ELSE res_name END AS res_name, CASE WHEN idx >= {FIRST} THEN 800 ELSE res_id END AS res_id, chain_id,
    CASE WHEN idx >= 19 AND sid % 13 = 0 THEN 'H' ELSE element END AS element, x / 2 AS x, y / 2 AS y, z / 2 AS z FROM atom),
two AS (SELECT sid, line + 50 AS line, hetero, atom_name, res_name, 801 AS res_id, chain_id, element, x + CASE WHEN sid % 2 = 0 THEN {SHIFT} ELSE 0.5 END AS x, y, z FROM one WHERE hetero),
every AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT sid, 100 + site_idx, true, 'ZN', 'ZN', 900 + site_idx, 'A', 'ZN', x / 2, y / 2, z / 2 FROM site)"""


def ge39(spark, d):
    """Templates out of structures, written as archives and read again; what has none keeps its fault."""
    specs = structures(spark, d).select(F.col("sid").alias("id"), F.lit("A").alias("protein_chain"), F.lit("LIG").alias("ligand_resname"), F.when(F.col("tier") == 1, "B2").otherwise("B1").alias("subclass"))
    found = templates.extract(bound_atoms(spark, d), specs)
    records = found.where("fault is null").select(F.concat(F.lit("t"), "id").alias("path"), F.to_json(F.struct("id", "subclass", "ligand_resname")).alias("metadata"), *npz.TEMPLATE_ARRAYS)
    path = sinks.shared_folder(spark, "templates")
    npz.archives(records, "metadata_json").write.parquet(path)
    read = npz.unpack_templates(spark.read.parquet(path))
    total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda x, y: x + y), 4)
    shown = read.select(
        F.get_json_object("metadata", "$.id").cast("long").alias("id"), F.size("metal_coords").alias("n_metals"), total("metal_coords").alias("metals"), F.array_join("donor_labels", ",").alias("donors"), F.array_join("donor_elements", "").alias("elements"),
        F.array_join(F.transform("donor_site_indices", lambda x: x.cast("string")), "").alias("site_of"), total("donor_coords").alias("donor_place"), F.size("ligand_coords").alias("n_ligand"), total("ligand_coords").alias("ligand_place"), F.array_join("ligand_atom_names", ",").alias("names"),
    )
    return found.select("id", "fault").join(shown, "id", "left")


def sk4(spark, d):
    """Pockets out of archives as PDB files, all atoms in chain A, read again by the data source."""
    pdb_source.register(spark)
    a = atoms(spark, d).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", F.array("x", "y", "z").alias("at"), "res_id", "atom_name", "res_name", "element"))).alias("a"))
    names = {"coords": "at", "res_ids": "res_id", "atom_names": "atom_name", "res_names": "res_name", "elements": "element"}
    pockets = a.select(F.concat(F.lit("s"), "sid").alias("path"), F.lit("{}").alias("metadata"), *(F.transform("a", _field(f)).alias(c) for c, f in names.items()))
    store, files = sinks.shared_folder(spark, "pockets"), sinks.shared_folder(spark, "pocket-files")
    npz.archives(pockets).write.parquet(store)
    lines = sinks.pocket_lines(npz.unpack(spark.read.parquet(store)))
    sinks.write_pocket_files(lines, files)
    back = spark.read.format("latticework_pdb").load(files)
    return back.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chain_id") == "A").alias("n_a"), F.round(F.sum(F.col("x") + F.col("y") + F.col("z")), 3).alias("total"), F.max("res_id").alias("last"), F.count_if(F.col("element") == "S").alias("n_s"))


def _field(name):
    return lambda z: z[name]


QUERIES = {"ge39_template_extraction": ge39, "sk4_pocket_files": sk4}

_CAN = "(" + " OR ".join(f"(res_name = '{r}' AND atom_name IN ({', '.join(repr(n) for n in names)}))" for r, names in DONORS.items()) + ")"
ORACLE_SQL = {
    "ge39_template_extraction": f"""WITH {ATOM_SQL}, {SITE_SQL}, {STRUCT_SQL}, {BOUND_SQL}, sp AS (SELECT sid, CASE WHEN tier = 1 THEN 1 ELSE 2 END AS want FROM structure),
      own AS (SELECT * FROM every WHERE chain_id = 'A'), lg AS (SELECT * FROM own WHERE hetero AND res_name = 'LIG'), zn AS (SELECT * FROM own WHERE element = 'ZN'),
      ap AS (SELECT g.sid, g.res_id, g.line, s.line AS zline, s.x AS zx, s.y AS zy, s.z AS zz, {D('g', 's')} AS d FROM lg g JOIN zn s USING (sid)),
      pick AS (SELECT sid, arg_min(res_id, (d, line)) AS res_id FROM (SELECT sid, res_id, min(d) AS d, min(line) AS line FROM ap GROUP BY ALL) GROUP BY sid),
      nz AS (SELECT sid, zline, zx AS x, zy AS y, zz AS z, min(d) AS d FROM ap JOIN pick USING (sid, res_id) GROUP BY ALL),
      mt AS (SELECT * FROM (SELECT nz.*, row_number() OVER (PARTITION BY sid ORDER BY d, zline) - 1 AS site FROM nz) JOIN sp USING (sid) WHERE site < want),
      mm AS (SELECT sid, min(d) AS d, count(*) AS n, round(sum(x + y + z), 4) AS metals FROM mt GROUP BY sid),
      hv AS (SELECT lg.* FROM lg JOIN pick USING (sid, res_id) WHERE element <> 'H'),
      hh AS (SELECT sid, count(*) AS n, round(sum(x + y + z), 4) AS place, string_agg(atom_name, ',' ORDER BY line) AS names FROM hv GROUP BY sid),
      dn AS (SELECT * FROM (SELECT a.*, m.site, {D('a', 'm')} AS d, row_number() OVER (PARTITION BY a.sid, a.line ORDER BY {D('a', 'm')}, m.site) AS rn FROM own a JOIN mt m USING (sid) WHERE NOT hetero AND {_CAN}) WHERE rn = 1 AND d <= {templates.DONOR_REACH}),
      dd AS (SELECT sid, count(*) AS n, count(DISTINCT site) AS served, string_agg(res_name || ':' || res_id || ':' || atom_name, ',' ORDER BY line) AS donors, string_agg(element, '' ORDER BY line) AS elements, string_agg(site::VARCHAR, '' ORDER BY line) AS site_of, round(sum(x + y + z), 4) AS place FROM dn GROUP BY sid),
      ft AS (SELECT sp.sid, CASE WHEN sp.sid NOT IN (SELECT sid FROM lg) THEN 'no ligand' WHEN sp.sid NOT IN (SELECT sid FROM zn) THEN 'no zinc' WHEN mm.n < want THEN 'too few zincs' WHEN mm.d > {templates.LIGAND_REACH} THEN 'ligand away from the metals'
        WHEN coalesce(dd.n, 0) < {templates.MIN_DONORS} THEN 'too few donors' WHEN served < want THEN 'a zinc without a donor' WHEN coalesce(hh.n, 0) < {templates.MIN_HEAVY} THEN 'too few heavy atoms' END AS fault,
        mm.n AS n_metals, metals, donors, elements, site_of, dd.place AS donor_place, hh.n AS n_ligand, hh.place AS ligand_place, names FROM sp LEFT JOIN mm USING (sid) LEFT JOIN dd USING (sid) LEFT JOIN hh USING (sid))
      SELECT sid AS id, fault, CASE WHEN fault IS NULL THEN n_metals END AS n_metals, CASE WHEN fault IS NULL THEN metals END AS metals, CASE WHEN fault IS NULL THEN donors END AS donors, CASE WHEN fault IS NULL THEN elements END AS elements,
        CASE WHEN fault IS NULL THEN site_of END AS site_of, CASE WHEN fault IS NULL THEN donor_place END AS donor_place, CASE WHEN fault IS NULL THEN n_ligand END AS n_ligand, CASE WHEN fault IS NULL THEN ligand_place END AS ligand_place, CASE WHEN fault IS NULL THEN names END AS names FROM ft""",
    "sk4_pocket_files": f"""WITH {ATOM_SQL}, r AS (SELECT 's' || sid AS id, printf('%.3f', x)::DOUBLE AS x, printf('%.3f', y)::DOUBLE AS y, printf('%.3f', z)::DOUBLE AS z, res_id, element FROM atom)
      SELECT id, count(*) AS n, count(*) AS n_a, round(sum(x + y + z), 3) AS total, max(res_id) AS last, count(*) FILTER (WHERE element = 'S') AS n_s FROM r GROUP BY id""",
}
