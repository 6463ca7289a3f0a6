"""Scans, sinks, filters and triage on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import moved, point
from ..operators import metrics as m
from ..operators import neighbours as nn
from ..operators import triage as t
from ..operators.ordered import before, sorted_digest
from ..operators.spatial import RESIDUES, residue_features
from ..operators.training import mine
from ..plans.views import ATOM_SQL, SITE_SQL, STRUCT_SQL, VEC_SQL, atoms, sites, structures, table, vectors
from ..sources import npz, paged, pdb_source, sinks
from ..sources import text as s


def _pdb_lines(spark, d):
    a = atoms(spark, d)
    line = s.pdb_line(F.col("idx") + 1, F.col("atom_name"), F.col("res_name"), F.col("chain_id"), F.col("res_id"), *(F.col(c) for c in "xyz"), F.lit(1.0), F.col("b_factor"), F.col("element"))
    return a.select(F.concat(F.lit("s"), "sid", F.lit(".pdb")).alias("path"), (F.col("idx") + 1).alias("line"), line.alias("value"))


def sc2(spark, d):
    p = s.parse_pdb(_pdb_lines(spark, d))
    return p.groupBy(s.stem(F.col("path")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.avg("b_factor"), 2).alias("b"), F.count_if(F.col("element") == "N").alias("n_n"), F.max("res_id").alias("last"))


def sk3(spark, d):
    return _pdb_lines(spark, d).select(s.stem(F.col("path")).alias("id"), "line", F.substring("value", 1, 30).alias("head"), F.length("value").alias("width"))


def sc7(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_name").alias("structure_id"), F.concat(F.lit("local:"), "p_partkey").alias("source_uri"), F.col("p_brand").alias("label"), F.col("p_size").alias("tier"), F.when(F.col("p_size") > 25, "  ").otherwise(F.col("p_type")).alias("subclass"),
                    F.when(F.col("p_partkey") % 3 == 0, "YES").otherwise("no").alias("is_predicted"), F.when(F.col("p_partkey") % 2 == 0, "1").otherwise("0").alias("is_reference_bank"))
    m = s.typed_manifest(rows)
    return m.select(F.substring("source_uri", 7, 20).cast("long").alias("key"), "tier", "subclass", "is_predicted", "is_reference_bank")


def sc8(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("r")).select("o_custkey", "r.o_orderkey", "r.o_orderstatus")


def _pair_lines(spark, d):
    li = table(spark, d, "lineitem")
    # Line numbers of an order repeat, so the other columns make the place of a line its own.
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    for c, most in (("l_quantity", 1), ("l_discount", 100), ("l_tax", 100)):
        place = place * 100 + F.round(F.col(c) * most).cast("long")
    v = F.concat_ws("\t", F.concat(F.lit("p"), F.col("l_partkey"), F.lit(".pdb")), F.concat(F.lit("p"), F.col("l_suppkey")), (F.col("l_quantity") * 2).cast("string"), F.lit("100"), (1 - F.col("l_discount")).cast("string"), (1 - F.col("l_tax")).cast("string"), F.lit("1e-5"))
    return li.select(F.lit("pairs").alias("path"), place.alias("line"), v.alias("value"))


def sc9(spark, d):
    p = s.last_of_pair(s.parse_pairs(_pair_lines(spark, d)), "identity", "coverage")
    return p.select("a", "b", F.round("identity", 6).alias("identity"), F.round("coverage", 6).alias("coverage"))


def sc10(spark, d):
    o = table(spark, d, "orders").select(F.lit("c").alias("path"), F.col("o_orderkey").alias("line"), F.concat_ws("\t", F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("value"))
    return s.parse_clusters(o).select(F.col("member").cast("long").alias("member"), "representative")


def sc11(spark, d):
    li = table(spark, d, "lineitem")
    cols = [F.concat(F.lit("p"), F.col("l_partkey"))] + [F.lit("-")] * 11 + [F.col("l_tax").cast("string"), F.col("l_extendedprice").cast("string"), F.lit("0.1"), F.lit("1"), F.lit("90"), F.col("l_linenumber").cast("string"), F.lit("99"), F.lit("1"), F.lit("99"), F.lit("0.9"), F.lit("text here")]
    lines = li.select(F.lit("dom").alias("path"), F.col("l_orderkey").alias("line"), F.concat_ws("   ", *cols).alias("value")).union(li.sparkSession.sql("select 'dom' path, 0L line, '# a comment' value"))
    ids = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") * 2).alias("id"))
    return s.best_domain(ids, s.parse_domains(lines))


def sc12(spark, d):
    x = table(spark, d, "documents")
    rec = s.fasta_record(F.concat(F.lit("d"), "doc_id", F.lit(" some words")), F.col("text"))
    f = s.parse_fasta(x.select(F.substring(rec, F.lit(2), F.length(rec)).alias("value")))
    return f.select("id", F.sha2("sequence", 256).alias("digest"), F.length("sequence").alias("n"))


def sc13(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.coalesce(F.try_element_at("m", F.lit("k")), F.lit(-1)).alias("k"), F.coalesce(F.size("m"), F.lit(0)).alias("n"))


def sc14(spark, d):
    """Mean of per-residue vectors: each vector is cut into four residues of sixteen numbers."""
    v = vectors(spark, d).select("id", F.posexplode("v").alias("p", "x"))
    m = v.groupBy("id", (F.col("p") % 16).alias("k")).agg(F.avg("x").alias("m"))
    return m.groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"), F.count(F.lit(1)).alias("width"))


def sc15(spark, d):
    v = vectors(spark, d).select("id", F.slice("v", 1, (F.lit(20) + F.col("id") % 3).cast("int")).alias("e"))
    n = atoms(spark, d).groupBy(F.col("sid").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return v.join(n, "id").select("id", (F.size("e") == F.col("n")).alias("aligned"), F.size(F.when(F.size("e") == F.col("n"), F.col("e"))).alias("used"))


def sc21(spark, d):
    p = table(spark, d, "part")
    lines = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.when(F.col("p_size") > 40, F.concat(F.lit("Pocket Score : "), F.col("p_retailprice"))).otherwise("Other : 1").alias("value"))
    return s.pocket_score(lines)


def sc22(spark, d):
    p = s.parse_pdb(_pdb_lines(spark, d)).where("atom_name = 'SG' and chain_id = 'A'")
    return p.groupBy(s.stem(F.col("path")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def sc23(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("/data/WP_"), "page_id", F.lit(".1.pdb")).alias("path"))
    return p.select(s.stem(F.col("path")).alias("id")).distinct()


def sk1(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("json"))


def sk6(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return o.select("o_custkey", F.concat_ws(",", *(F.coalesce(F.col(c), F.lit(0)) for c in "FOP")).alias("row"))


def sc2_source(spark, d):
    """Chain A's nitrogens out of files, by the data source; both conditions are the reader's."""
    pdb_source.register(spark)
    path = sinks.shared_folder(spark, "structures")
    rows = _pdb_lines(spark, d).withColumn("id", s.stem(F.col("path")))
    sinks.write_pocket_files(rows, path)
    found = spark.read.format("latticework_pdb").schema("id string, chain_id string, element string, x double, y double, z double, b_factor double").load(path)
    found = found.where((F.col("chain_id") == "A") & F.col("element").isin("N", "O"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("element") == "O").alias("n_o"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum(F.col("y") + F.col("z")), 3).alias("syz"), F.round(F.avg("b_factor"), 2).alias("b"))


def _accept():
    return [t.hash_sample(F.col("accession"), 0.5), t.composition(F.col("sequence"), {"H": 3, "D": 1, "C": 1})]


def _entries(spark, d):
    e = table(spark, d, "documents").where("text is not null")
    return e.select(F.format_string("P%09d", "doc_id").alias("accession"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"), F.col("lang").alias("organism"))


def sc17(spark, d):
    """Every page of a paged store, sampled by hash and by composition."""
    paged.register(spark)
    path = sinks.shared_folder(spark, "pages")
    paged.write_pages(_entries(spark, d), path, 500)
    found = spark.read.format("latticework_paged").load(path)
    for condition in _accept():
        found = found.where(condition)
    return found.select("accession", "organism", F.length("sequence").alias("n"))


def sc18(spark, d):
    """A scan that stops at the store's end and goes on when pages were added; labelled entries are excluded."""
    path, out, state = (sinks.shared_folder(spark, n) for n in ("pages", "accepted", "state"))
    entries = _entries(spark, d)
    half = entries.agg(F.max("accession")).first()[0]
    half = f"P{int(half[1:]) // 2:09d}" if half else ""
    excluded = table(spark, d, "labels").select(F.format_string("P%09d", "doc_id").alias("accession")).distinct()
    paged.write_pages(entries.where(F.col("accession") < half), path, 200)
    paged.scan_into(spark, path, out, state, _accept(), excluded)
    pages = spark.read.parquet(path).agg(F.max(F.col("cursor").cast("int"))).first()[0]
    paged.write_pages(entries.where(F.col("accession") >= half), path, 200, first=pages + 1)
    paged.scan_into(spark, path, out, state, _accept(), excluded)
    return spark.read.parquet(out).select("accession", "organism", F.length("sequence").alias("n"))


def fi5(spark, d):
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, d, "documents").where(t.composition(up, {"H": 3, "D": 1, "C": 1})).select("doc_id")


def fi6(spark, d):
    return table(spark, d, "documents").where(t.hash_sample(F.col("doc_id").cast("string"), 0.05)).select("doc_id")


def fi7(spark, d):
    x = table(spark, d, "documents")
    return t.exclude(x.select("doc_id"), "doc_id", table(spark, d, "labels").select("doc_id"), x.where("lang = 'de'").select("doc_id"))


def fi8(spark, d):
    tier = t.map_or_fail(F.col("o_orderpriority"), {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "4-LOW": 1, "5-LOW": 1}, "priority")
    return table(spark, d, "orders").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def fi9(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "R", "positive").when(F.col("l_returnflag") == "N", "easy_negative").otherwise("other").alias("label"), F.col("l_linenumber").alias("tier"), F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("subclass"), (F.col("l_suppkey") % 3 == 0).alias("is_reference"))
    return t.validate_manifest(x).groupBy("violation").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def fi10(spark, d):
    return t.compare_ids(table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def fi11(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("source = 'src3'").select("doc_id")
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_overlap"))


def fi12(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(done, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n_left"))


def fi14(spark, d):
    return atoms(spark, d).groupBy("sid").agg(F.avg("b_factor").alias("m")).select("sid", F.round("m", 6).alias("mean"), (F.col("m") < 70).alias("warn"))


def fi15(spark, d):
    v = vectors(spark, d).select("id", F.transform("v", lambda x, i: F.when(i.between(10, 29), 0.0).otherwise(x)).alias("v"))
    return v.select("id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))


def fi16(spark, d):
    v = vectors(spark, d).select("id", F.concat(F.slice("v", 1, 22), F.slice("v", 38, 64)).alias("v"))
    return v.select("id", F.size("v").alias("width"), F.round(F.element_at("v", 23), 6).alias("x23"))


def fi17(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", F.coalesce(F.col("quality"), F.lit(-1)).alias("quality"), F.when(F.col("toxic") == 1, "toxic").otherwise(F.coalesce("source", F.lit("unknown"))).alias("family"))


def fi18(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("reference").alias("kind"))
    return r.unionByName(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("catalog").alias("kind")))


def fi19(spark, d):
    x = table(spark, d, "documents")
    x = x.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    own = sorted_digest(x, "source", ["h"], "h", "").withColumnRenamed("digest", "h")
    again = sorted_digest(x.where("doc_id <> 7"), "source", ["h"], "h", "").withColumnRenamed("digest", "g")
    return own.join(again, "source").select("source", (F.col("h") == F.col("g")).alias("same"))


def tr1(spark, d):
    x = table(spark, d, "lineitem").select(t.two_channel(F.when(F.col("l_quantity") > 30, "supported").when(F.col("l_quantity") > 10, "not_supported"), F.when(F.col("l_discount") > 0.05, "positive").when(F.col("l_discount") > 0.02, "negative")).alias("triage"))
    return x.groupBy("triage").agg(F.count(F.lit(1)).alias("n"))


def tr2(spark, d):
    x = table(spark, d, "lineitem")
    ok = t.broad_shortlist(F.when(F.col("l_linenumber") < 6, F.col("l_quantity") > 20), F.col("l_quantity") * 2, F.when(F.col("l_tax") > 0.01, F.col("l_tax") > 0.06), F.when(F.col("l_discount") > 0.01, F.when(F.col("l_discount") > 0.05, "positive").otherwise("negative")))
    return x.where(ok).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def tr3(spark, d):
    x = table(spark, d, "lineitem").where((F.col("l_quantity") > 20) & ~(F.col("l_tax") > 0.05) & ~(F.col("l_discount") > 0.05))
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def tr4(spark, d):
    """Status of every structure: some were never fetched, in some a line has lost its coordinates."""
    sid = F.substring_index(s.stem(F.col("path")), "s", -1).cast("long")
    lines = _pdb_lines(spark, d).where(sid % 9 != 0)
    torn = F.when((sid % 7 == 0) & (F.col("line") > 2), F.concat(F.substring("value", 1, 34), F.lit("--"), F.substring("value", 37, 50))).otherwise(F.col("value"))
    return s.scan_status(structures(spark, d).select(F.concat(F.lit("s"), "sid").alias("id")), lines.withColumn("value", torn))


def sc1(spark, d):
    """Structure scan: of two models in a file the first one counts, with its temperature factors."""
    one = _pdb_lines(spark, d)
    end = one.where("line = 1").select("path", F.lit(100).alias("line"), F.lit("ENDMDL").alias("value"))
    again = one.select("path", F.col("line") + 200, "value")
    p = s.parse_pdb(one.union(end).union(again))
    return p.groupBy(s.stem(F.col("path")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("b_factor"), 2).alias("b"))


def sc3(spark, d):
    """Probe scan: the occupancy column holds the probability of a site."""
    a = atoms(spark, d)
    line = s.pdb_line(F.col("idx") + 1, F.col("atom_name"), F.col("res_name"), F.col("chain_id"), F.col("res_id"), *(F.col(c) for c in "xyz"), F.least(F.lit(1.0), F.col("b_factor") / 100), F.lit(0.0), F.col("element"))
    p = s.parse_pdb(a.select(F.concat(F.lit("s"), "sid").alias("path"), "idx", line.alias("value")).withColumnRenamed("idx", "line"))
    return p.groupBy(F.col("path").alias("id")).agg(F.round(F.sum("occupancy"), 2).alias("total"), F.count_if(F.col("occupancy") >= 0.5).alias("n_sites"))


def _metals(spark, d):
    m = F.struct("site_idx", F.array("x", "y", "z").alias("at"), F.col("probability").alias("p"))
    return sites(spark, d).groupBy("sid").agg(F.array_sort(F.collect_list(m)).alias("m"))


def sc4(spark, d):
    """Pocket archives, written and read: every fourth is of the older kind with one metal, some of them without a
    confidence; a pocket without metals has none."""
    a = atoms(spark, d).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", F.array("x", "y", "z").alias("at"), "res_id", "atom_name"))).alias("a"))
    old, given = F.col("sid") % 4 == 0, F.size("m") > 0
    conf = F.when(old & given & (F.col("sid") % 8 != 0), F.col("m")[0]["p"])
    r = a.join(_metals(spark, d), "sid", "left").select(
        F.concat(F.lit("s"), "sid").alias("path"), F.to_json(F.struct("sid", conf.alias("metal_confidence"))).alias("metadata"),
        F.transform("a", lambda z: z["at"]).alias("coords"), F.transform("a", lambda z: z["res_id"]).alias("res_ids"), F.transform("a", lambda z: z["atom_name"]).alias("atom_names"),
        F.when(~old & given, F.transform("m", lambda z: z["at"])).alias("metal_coords"), F.when(~old & given, F.transform("m", lambda z: z["p"])).alias("metal_probabilities"), F.when(old & given, F.col("m")[0]["at"]).alias("metal_coord"),
    )
    path = sinks.shared_folder(spark, "pockets")
    npz.archives(r).write.parquet(path)
    p = npz.unpack(spark.read.parquet(path))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    return p.select(F.col("path").alias("id"), "n_atoms", F.size("metal_coords").alias("n_metals"), F.round(add("metal_probabilities"), 6).alias("p"), F.round(add(F.flatten("metal_coords")), 6).alias("place"), F.round(add(F.flatten("coords")), 5).alias("total"))


def sc6(spark, d):
    """Two-metal templates: what is wrong with each structure as a template of its family's first subclass."""
    x = structures(spark, d).join(_metals(spark, d), "sid", "left")
    fault = s.template_fault(F.when(F.col("family") != "", F.col("sid")), F.col("sid"), F.col("subclass"), F.lit("B1"), F.coalesce(F.size("m"), F.lit(0)))
    return x.select("sid", fault.alias("fault"))


def sk5(spark, d):
    """FASTA, written and read back; texts without a letter are not written."""
    path = sinks.shared_folder(spark, "fasta")
    x = table(spark, d, "documents")
    sinks.write_fasta(x, F.concat(F.lit("d"), "doc_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), path)
    return s.read_fasta(spark, path).select("id", F.length("sequence").alias("n"), F.sha2("sequence", 256).alias("digest"))


def sk7(spark, d):
    """An export is made when no row failed, and read back."""
    path = sinks.shared_folder(spark, "export")
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    sinks.export_all_or_none(x.withColumn("failed", F.col("last").isNull()), "failed", path)
    return spark.read.parquet(path)


def tr6(spark, d):
    x = table(spark, d, "pages").select(F.when(F.contains("html", F.lit("</html>")), "ok").otherwise("failed").alias("status"), F.length("html").alias("n"))
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


def tr7(spark, d):
    """Triplets: each positive with another positive and a negative, chosen by hash, the same in every run."""
    e = structures(spark, d).select("sid", "label", F.sha2(F.col("sid").cast("string"), 256).alias("h"))
    ranked = lambda label: before(e.where(F.col("label") == label), ["h"], "r").withColumn("r", F.col("r") + 1)
    pos, neg = ranked("positive").select("sid", "r"), ranked("negative").select(F.col("sid").alias("negative"), "r")
    n = pos.count()
    nxt = pos.select(F.col("sid").alias("positive"), F.when(F.col("r") == 1, n).otherwise(F.col("r") - 1).alias("r"))
    return pos.join(nxt, "r").join(neg, "r").select(F.col("sid").alias("anchor"), "positive", "negative")


def tr8(spark, d):
    """Semi-hard mining: d_ap < d_an < d_ap + margin, the nearest such negative; else the nearest of all."""
    return mine(vectors(spark, d), 0.2).select(F.col("a").alias("q"), F.col("p").alias("positive"), F.col("n").alias("negative"))


def tr9(spark, d):
    e = table(spark, d, "embeddings")
    w = lambda c: F.element_at(F.array(F.lit(1.0), F.lit(0.85), F.lit(0.6), F.lit(0.35)), (c % 4 + 1).cast("int"))
    rows = e.select(F.abs(F.element_at("embedding", 1).cast("double")).alias("d_ap"), F.abs(F.element_at("embedding", 2).cast("double")).alias("d_an"), w(F.col("vec_id")).alias("w_anchor"), w(F.col("vec_id") + 1).alias("w_positive"))
    return t.triplet_loss(rows, 0.1).select(F.round("loss", 6).alias("loss"))


def tr10(spark, d):
    """One message-passing step: a node's mean over its neighbours on the embedding ring."""
    v = vectors(spark, d).select("id", F.posexplode(F.slice("v", 1, 4)).alias("k", "x"))
    edge = v.select("id", F.explode(F.array(F.col("id") - 1, F.col("id") + 1, F.col("id") + 7)).alias("src")).distinct()
    return edge.join(v.select(F.col("id").alias("src"), "k", "x"), "src").groupBy("id", "k").agg(F.round(F.avg("x"), 6).alias("x"))


#: TR13's configurations: which numbers of a vector each one sees.
CONFIGURATIONS = {"flat": (1, 64), "enhanced": (1, 32), "branched": (33, 64), "structure_only": (1, 16)}
SEEDS = 3


def tr13(spark, d):
    """Four configurations, each with three seeds that leave out a third of the training set: votes of neighbours, votes
    over seeds, and rates by panel.  Two seeds have a third in common, so each third is searched once."""
    v = vectors(spark, d)
    calls = None
    for config, (low, high) in CONFIGURATIONS.items():
        own = v.withColumn("v", F.slice("v", low, high - low + 1)).withColumn("third", F.col("id") % SEEDS)
        near = nn.nearest_leaving_out(own.where("part = 'query'").select("id", "v"), own.where("part = 'train'").select("id", "v", "label", "third"), "third", list(range(SEEDS)), 5)
        votes = nn.majority(near, ["left_out", "q"]).select(F.lit(config).alias("config"), F.col("left_out").alias("seed"), "q", F.col("pred").alias("vote"))
        calls = votes if calls is None else calls.union(votes)
    n = calls.groupBy("config", "q", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("first"))
    voted = n.groupBy("config", "q").agg(F.max_by("vote", F.struct("n", -F.col("first"))).alias("pred"))
    truth = v.select(F.col("id").alias("q"), (F.col("label") == "positive").alias("truth"), F.concat(F.lit("tier"), F.col("id") % 4 + 1).alias("panel"))
    counts = voted.join(truth, "q").groupBy("config", "panel").agg(*m.confusion(F.col("pred") == "positive", F.col("truth")))
    return m.rates(counts, ["config", "panel"], "one")


def tr14(spark, d):
    """Candidate record: structural status, retrieval and their triage, in one row."""
    q, train = vectors(spark, d).where("part = 'query'"), vectors(spark, d).where("part = 'train'")
    r = nn.vote_fraction(nn.nearest(q, train, 5), F.col("label") == "positive").select(F.col("q").alias("sid"), F.col("pred"))
    st = structures(spark, d).where("sid % 5 = 0").select("sid", F.when(F.col("tier") == 1, F.when(F.col("family") == "", "unavailable").otherwise("supported")).otherwise("not_supported").alias("status"))
    return st.join(r, "sid").select("sid", "status", "pred", t.two_channel(F.col("status"), F.col("pred")).alias("triage"))


def tr15(spark, d):
    """Freeze: the settings of a conversation's user turns must agree but for seed and loss."""
    c = table(spark, d, "conversations").where("role = 'user'")
    size = F.when(F.length("text") > 300, "long").otherwise("short")
    given = F.create_map(F.lit("role"), F.col("role"), F.lit("size"), size, F.lit("seed"), F.col("turn").cast("string"), F.lit("loss"), F.length("text").cast("string"))
    asks = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit(",")), F.create_map(F.lit("comma"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.agreeing_settings(c.select("conv_id", F.map_concat(given, asks).alias("settings")), "conv_id", "settings")


def tr16(spark, d):
    """Comparator calls: every expected id must be there."""
    have = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("call"))
    want = table(spark, d, "documents").select("doc_id")
    j = want.join(have, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("call").isNull()).alias("missing"), F.count_if("call").alias("called"))


def ge9(spark, d):
    """Rigid transform: a turn about z, by an angle of its own for each structure, and a shift."""
    c, n, zero, one = F.cos("sid"), F.sin("sid"), F.lit(0.0), F.lit(1.0)
    a = atoms(spark, d).withColumns({"rotation": F.array(c, n, zero, -n, c, zero, zero, zero, one), "translation": F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))})
    return a.select("sid", "idx", *(F.round(v, 6).alias(k) for v, k in zip(moved(point(), F.col("rotation"), F.col("translation")), "xyz", strict=True)))


def ge30(spark, d):
    """Sums of each feature over a structure's atoms; every third atom has a residue outside the table."""
    name = F.when(F.col("idx") % 3 == 2, "UNK").otherwise(F.col("res_name"))
    f = atoms(spark, d).select("sid", F.posexplode(residue_features(name)).alias("k", "v"))
    return f.groupBy("sid", "k").agg(F.round(F.sum("v"), 4).alias("total"))


def ge44(spark, d):
    a = atoms(spark, d).groupBy("sid", "chain_id", "res_id").agg(F.min_by("res_name", "idx").alias("r"))
    one = F.when(F.col("r") == "ASP", "D").when(F.col("r") == "CYS", "C").when(F.col("r") == "HIS", "H")
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_id", one.alias("l")))), lambda z: z["l"]), "")
    return a.groupBy("sid", "chain_id").agg(seq.alias("sequence"))


QUERIES = {
    "sc1_structure_scan": sc1, "sc3_probe_scan": sc3, "sc4_pocket_archives": sc4, "sc6_template_check": sc6, "sk5_fasta": sk5, "sk7_all_or_none": sk7,
    "sc2_pdb_parse": sc2, "sc7_manifest": sc7, "sc8_keyed_last": sc8, "sc9_pair_table": sc9, "sc10_clusters": sc10, "sc11_domains": sc11, "sc12_fasta": sc12, "sc13_json": sc13, "sc14_mean_pool": sc14, "sc15_alignment_guard": sc15,
    "sc21_pocket_score": sc21, "sc22_record_extraction": sc22, "sc23_ids": sc23, "sc2_pdb_source": sc2_source, "sc17_paged_scan": sc17, "sc18_resumable_scan": sc18, "sk1_json": sk1, "sk3_pdb_lines": sk3, "sk6_pivot_rows": sk6, "fi5_composition": fi5, "fi6_hash_sample": fi6, "fi7_exclusion": fi7, "fi8_mapping": fi8,
    "fi9_validation": fi9, "fi10_id_sets": fi10, "fi11_overlap": fi11, "fi12_resume": fi12, "fi14_confidence": fi14, "fi15_ablation": fi15, "fi16_slice": fi16, "fi17_metadata": fi17, "fi18_union": fi18, "fi19_hash_guard": fi19,
    "tr1_triage": tr1, "tr2_shortlist": tr2, "tr3_pilot": tr3, "tr4_error_status": tr4, "tr6_report": tr6, "tr7_triplets": tr7, "tr8_semi_hard": tr8, "tr9_triplet_loss": tr9, "tr10_message_passing": tr10, "tr13_per_seed": tr13,
    "tr14_candidate": tr14, "tr15_freeze": tr15, "tr16_comparator": tr16, "ge9_transform": ge9, "ge30_one_hot": ge30, "ge44_chain_sequences": ge44,
}

_UP = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_PL = "pl AS (SELECT (((l_orderkey * 10 + l_linenumber) * 100 + round(l_quantity)::BIGINT) * 100 + round(l_discount * 100)::BIGINT) * 100 + round(l_tax * 100)::BIGINT AS line, 'p' || l_partkey AS q, 'p' || l_suppkey AS t, l_quantity * 2 / 100 AS identity, least(1 - l_discount, 1 - l_tax) AS coverage FROM lineitem)"
_ENTRIES = "WITH e AS (SELECT doc_id, printf('P%09d', doc_id) AS accession, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence, lang AS organism FROM documents WHERE text IS NOT NULL)"
_SAMPLED = "('0x' || substr(sha256(accession), 1, 8))::BIGINT / 4294967295.0 < 0.5 AND " + " AND ".join(f"length(sequence) - length(replace(sequence, '{c}', '')) >= {n}" for c, n in (("H", 3), ("D", 1), ("C", 1)))
ORACLE_SQL = {
    "sc2_pdb_parse": f"WITH {ATOM_SQL} SELECT 's' || sid AS id, count(*) AS n, round(sum(printf('%.3f', x)::DOUBLE), 3) AS sx, round(avg(printf('%.2f', b_factor)::DOUBLE), 2) AS b, count(*) FILTER (WHERE element = 'N') AS n_n, max(res_id)::INT AS last FROM atom GROUP BY sid",
    "sc7_manifest": "SELECT p_partkey AS key, p_size AS tier, CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS subclass, p_partkey % 3 = 0 AS is_predicted, p_partkey % 2 = 0 AS is_reference_bank FROM part",
    "sc8_keyed_last": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "sc9_pair_table": f"WITH {_PL} SELECT least(q, t) AS a, greatest(q, t) AS b, round(arg_max(identity, line), 6) AS identity, round(arg_max(coverage, line), 6) AS coverage FROM pl WHERE q <> t GROUP BY 1, 2",
    "sc10_clusters": "SELECT o_custkey AS member, arg_max(o_orderpriority, o_orderkey) AS representative FROM orders GROUP BY o_custkey",
    "sc11_domains": "SELECT 'p' || (p_partkey * 2) AS id, max(l_extendedprice) AS best_score, count(l_partkey) AS n_domains FROM part LEFT JOIN lineitem ON l_partkey = p_partkey * 2 GROUP BY p_partkey",
    "sc12_fasta": "SELECT 'd' || doc_id AS id, sha256(regexp_replace(text, '\\s', '', 'g')) AS digest, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents",
    "sc13_json": "SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, len(json_keys(props)) AS n FROM events",
    "sc14_mean_pool": f"WITH {VEC_SQL}, m AS (SELECT id, (p - 1) % 16 AS k, avg(v[p]) AS m FROM vec, unnest(range(1, 65)) AS t(p) GROUP BY ALL) SELECT id, round(sqrt(sum(m * m)), 6) AS norm, count(*) AS width FROM m GROUP BY id",
    "sc15_alignment_guard": "SELECT vec_id AS id, vec_id % 3 = 1 AS aligned, CASE WHEN vec_id % 3 = 1 THEN 21 ELSE NULL END AS used FROM embeddings",
    "sc21_pocket_score": "SELECT p_brand AS path, arg_min(p_retailprice, p_partkey) FILTER (WHERE p_size > 40) AS score FROM part GROUP BY p_brand",
    "sc22_record_extraction": f"WITH {ATOM_SQL} SELECT 's' || sid AS id, count(*) AS n FROM atom WHERE atom_name = 'SG' AND chain_id = 'A' GROUP BY sid",
    "sc2_pdb_source": f"""WITH {ATOM_SQL}, o AS (SELECT 's' || sid AS id, element, printf('%.3f', x)::DOUBLE AS x, printf('%.3f', y)::DOUBLE AS y, printf('%.3f', z)::DOUBLE AS z, printf('%.2f', b_factor)::DOUBLE AS b FROM atom WHERE chain_id = 'A' AND element IN ('N', 'O'))
      SELECT id, count(*) AS n, count(*) FILTER (WHERE element = 'O') AS n_o, round(sum(x), 3) AS sx, round(sum(y + z), 3) AS syz, round(avg(b), 2) AS b FROM o GROUP BY id""",
    "sc17_paged_scan": f"{_ENTRIES} SELECT accession, organism, length(sequence) AS n FROM e WHERE {_SAMPLED}",
    "sc18_resumable_scan": f"{_ENTRIES} SELECT accession, organism, length(sequence) AS n FROM e WHERE {_SAMPLED} AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "sc23_ids": "SELECT DISTINCT 'WP_' || page_id || '.1' AS id FROM pages",
    "sk1_json": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "sk3_pdb_lines": f"WITH {ATOM_SQL} SELECT 's' || sid AS id, idx + 1 AS line, printf('ATOM  %5d %-4s %3s %1s%4d    ', idx + 1, atom_name, res_name, chain_id, res_id) AS head, 78 AS width FROM atom",
    "sk6_pivot_rows": "SELECT o_custkey, concat_ws(',', count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_orderstatus = 'P')) AS row FROM orders GROUP BY o_custkey",
    "fi5_composition": f"SELECT doc_id FROM documents WHERE length({_UP}) - length(replace({_UP}, 'H', '')) >= 3 AND length({_UP}) - length(replace({_UP}, 'D', '')) >= 1 AND length({_UP}) - length(replace({_UP}, 'C', '')) >= 1",
    "fi6_hash_sample": "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.05",
    "fi7_exclusion": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'de')",
    "fi8_mapping": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS tier, count(*) AS n FROM orders GROUP BY 1",
    "fi9_validation": """WITH x AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'N' THEN 'easy_negative' ELSE 'other' END AS label, l_linenumber AS tier, CASE WHEN l_tax > 0.02 THEN l_linestatus END AS subclass, l_suppkey % 3 = 0 AS ref FROM lineitem),
      v AS (SELECT id, 'duplicate_id' AS violation FROM x GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'invalid_tier' FROM x WHERE tier NOT BETWEEN 1 AND 4 UNION ALL SELECT id, 'invalid_label' FROM x WHERE label = 'other'
      UNION ALL SELECT id, 'reference_not_positive' FROM x WHERE ref AND label <> 'positive' UNION ALL SELECT id, 'positive_without_subclass' FROM x WHERE label = 'positive' AND subclass IS NULL) SELECT violation, count(*) AS n, min(id) AS first FROM v GROUP BY violation""",
    "fi10_id_sets": """WITH w AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT doc_id, 'missing' AS side FROM w WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM w))
      SELECT side, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS examples FROM s GROUP BY side""",
    "fi11_overlap": "SELECT count(*) AS n_overlap FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE source = 'src3')",
    "fi12_resume": "SELECT lang, count(*) AS n_left FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
    "fi14_confidence": f"WITH {ATOM_SQL} SELECT sid, round(avg(b_factor), 6) AS mean, avg(b_factor) < 70 AS warn FROM atom GROUP BY sid",
    "fi15_ablation": f"WITH {VEC_SQL} SELECT id, 64 AS width, round(list_sum(list_transform(v, lambda x, i: CASE WHEN i BETWEEN 11 AND 30 THEN 0 ELSE x * x END)), 6) AS energy FROM vec",
    "fi16_slice": f"WITH {VEC_SQL} SELECT id, 49 AS width, round(v[38], 6) AS x23 FROM vec",
    "fi17_metadata": "SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'toxic' ELSE coalesce(source, 'unknown') END AS family FROM documents LEFT JOIN labels USING (doc_id)",
    "fi18_union": "SELECT r_regionkey AS key, r_name AS name, 'reference' AS kind FROM region UNION ALL SELECT n_nationkey, n_name, 'catalog' FROM nation",
    "fi19_hash_guard": "SELECT source, NOT bool_or(doc_id = 7) AS same FROM documents GROUP BY source",
    "tr1_triage": "SELECT CASE WHEN l_quantity > 30 AND l_discount > 0.05 THEN 'dual_support' WHEN l_quantity > 30 THEN 'structure_only' WHEN l_discount > 0.05 THEN 'retrieval_only' ELSE 'unresolved' END AS triage, count(*) AS n FROM lineitem GROUP BY 1",
    "tr2_shortlist": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber < 6 AND l_quantity > 20 AND l_quantity * 2 >= 70 AND NOT l_tax > 0.06 AND NOT l_discount > 0.05 GROUP BY 1",
    "tr3_pilot": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 20 AND NOT l_tax > 0.05 AND NOT l_discount > 0.05 GROUP BY 1",
    "sc1_structure_scan": f"WITH {ATOM_SQL} SELECT 's' || sid AS id, count(*) AS n, round(avg(printf('%.2f', b_factor)::DOUBLE), 2) AS b FROM atom GROUP BY sid",
    "sc3_probe_scan": f"WITH {ATOM_SQL}, o AS (SELECT sid, printf('%.2f', least(1.0, b_factor / 100))::DOUBLE AS o FROM atom) SELECT 's' || sid AS id, round(sum(o), 2) AS total, count(*) FILTER (WHERE o >= 0.5) AS n_sites FROM o GROUP BY sid",
    "sc4_pocket_archives": f"""WITH {ATOM_SQL}, {SITE_SQL}, m AS (SELECT sid, count(*) AS n_metals, sum(CASE WHEN sid % 8 = 0 THEN 0.7 ELSE probability END) AS p, sum(x + y + z) AS place FROM site WHERE sid % 4 <> 0 OR site_idx = 0 GROUP BY sid)
      SELECT 's' || sid AS id, count(*)::INT AS n_atoms, any_value(n_metals)::INT AS n_metals, round(any_value(p), 6) AS p, round(any_value(place), 6) AS place, round(sum(x + y + z), 5) AS total FROM atom LEFT JOIN m USING (sid) GROUP BY sid""",
    "sc6_template_check": f"""WITH {STRUCT_SQL}, {SITE_SQL}, m AS (SELECT sid, count(*) AS n FROM site GROUP BY sid) SELECT sid, CASE WHEN family = '' THEN 'template_id differs' WHEN subclass IS DISTINCT FROM 'B1' THEN 'subclass differs'
      WHEN n IS DISTINCT FROM 2 THEN 'a template has two metals' END AS fault FROM structure LEFT JOIN m USING (sid)""",
    "sk5_fasta": "WITH x AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM documents) SELECT 'd' || doc_id AS id, length(t) AS n, sha256(t) AS digest FROM x WHERE length(t) > 0",
    "sk7_all_or_none": "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey",
    "tr4_error_status": """SELECT 's' || vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN 'no_structure_fetched' WHEN vec_id % 7 = 0 THEN 'unavailable' ELSE 'scored' END AS status,
      CASE WHEN vec_id % 9 <> 0 AND vec_id % 7 = 0 THEN 'line 3: a coordinate is no number' END AS reason, CASE WHEN vec_id % 9 <> 0 AND vec_id % 7 <> 0 THEN 21 END AS n_atoms FROM embeddings""",
    "tr6_report": "SELECT CASE WHEN contains(html, '</html>') THEN 'ok' ELSE 'failed' END AS status, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
    "tr7_triplets": f"""WITH {STRUCT_SQL}, p AS (SELECT sid, row_number() OVER (ORDER BY sha256(sid::VARCHAR)) AS r FROM structure WHERE label = 'positive'), n AS (SELECT sid, row_number() OVER (ORDER BY sha256(sid::VARCHAR)) AS r FROM structure WHERE label = 'negative')
      SELECT p.sid AS anchor, q.sid AS positive, n.sid AS negative FROM p JOIN p q ON q.r = p.r % (SELECT count(*) FROM p) + 1 JOIN n ON n.r = p.r""",
    "tr8_semi_hard": f"""WITH {VEC_SQL}, v AS (SELECT * FROM vec), a AS (SELECT * FROM v WHERE label = 'positive'), ap AS (SELECT a.id AS q, min(list_distance(a.v, b.v)) AS ap, arg_min(b.id, (list_distance(a.v, b.v), b.id)) AS positive FROM a JOIN v b ON b.label = 'positive' AND a.id <> b.id GROUP BY a.id),
      an AS (SELECT a.id AS q, b.id, list_distance(a.v, b.v) AS d FROM a JOIN v b ON b.label = 'negative') SELECT q, positive, coalesce(arg_min(id, (d, id)) FILTER (WHERE d > ap AND d < ap + 0.2), arg_min(id, (d, id))) AS negative FROM an JOIN ap USING (q) GROUP BY q, positive""",
    "tr9_triplet_loss": "WITH r AS (SELECT abs(embedding[1]::DOUBLE) AS ap, abs(embedding[2]::DOUBLE) AS an, least([1.0, 0.85, 0.6, 0.35][vec_id % 4 + 1], [1.0, 0.85, 0.6, 0.35][(vec_id + 1) % 4 + 1])::DOUBLE AS w FROM embeddings) SELECT round(sum(w * greatest(0, 0.1 + ap - an)) / greatest(sum(w), 1e-8), 6) AS loss FROM r",
    "tr10_message_passing": f"WITH {VEC_SQL}, e AS (SELECT DISTINCT id, id + k AS src FROM vec, (VALUES (-1), (1), (7)) AS t(k)) SELECT e.id, p - 1 AS k, round(avg(v[p]), 6) AS x FROM e JOIN vec s ON s.id = e.src, unnest(range(1, 5)) AS u(p) GROUP BY ALL",
    "tr13_per_seed": f"""WITH {VEC_SQL}, cfg(config, lo, hi) AS (VALUES {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in CONFIGURATIONS.items())}), sd(seed) AS (SELECT unnest(range(0, {SEEDS}))),
      pr AS (SELECT config, seed, q.id AS q, t.label, row_number() OVER (PARTITION BY config, seed, q.id ORDER BY list_distance(q.v[lo:hi], t.v[lo:hi]), t.id) AS r FROM vec q, vec t, cfg, sd WHERE q.part = 'query' AND t.part = 'train' AND t.id % {SEEDS} <> seed),
      k AS (SELECT config, seed, q, label, count(*) AS n, min(r) AS f FROM pr WHERE r <= 5 GROUP BY ALL), v AS (SELECT config, seed, q, arg_max(label, (n, -f)) AS vote FROM k GROUP BY ALL),
      w AS (SELECT config, q, vote, count(*) AS n, min(seed) AS f FROM v GROUP BY ALL), z AS (SELECT config, q, arg_max(vote, (n, -f)) = 'positive' AS y FROM w GROUP BY ALL),
      c AS (SELECT config, 'tier' || (q % 4 + 1) AS panel, count(*) FILTER (WHERE label = 'positive' AND y) AS tp, count(*) FILTER (WHERE label <> 'positive' AND NOT y) AS tn, count(*) FILTER (WHERE label <> 'positive' AND y) AS fp, count(*) FILTER (WHERE label = 'positive' AND NOT y) AS fn
        FROM z JOIN vec ON vec.id = z.q GROUP BY ALL)
      SELECT config, panel, tp, tn, fp, fn, tp + tn + fp + fn AS n, round(tp / greatest(tp + fn, 1), 6) AS sensitivity, round(tn / greatest(tn + fp, 1), 6) AS specificity, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 6) AS balanced_accuracy,
        round((tp + tn) / greatest(tp + tn + fp + fn, 1), 6) AS accuracy FROM c""",
    "tr14_candidate": f"""WITH {VEC_SQL}, {STRUCT_SQL}, pr AS (SELECT q.id AS q, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS r FROM vec q, vec t WHERE q.part = 'query' AND t.part = 'train'),
      g AS (SELECT q AS sid, CASE WHEN avg((label = 'positive')::INT) > 0.5 THEN 'positive' ELSE 'negative' END AS pred FROM pr WHERE r <= 5 GROUP BY q), s AS (SELECT sid, CASE WHEN tier = 1 THEN CASE WHEN family = '' THEN 'unavailable' ELSE 'supported' END ELSE 'not_supported' END AS status FROM structure)
      SELECT sid, status, pred, CASE WHEN status = 'supported' AND pred = 'positive' THEN 'dual_support' WHEN status = 'supported' THEN 'structure_only' WHEN pred = 'positive' THEN 'retrieval_only' ELSE 'unresolved' END AS triage FROM s JOIN g USING (sid)""",
    "tr15_freeze": """WITH c AS (SELECT conv_id, count(*) AS runs, count(DISTINCT length(text) > 300) > 1 AS sizes, count(*) FILTER (WHERE contains(text, ',')) BETWEEN 1 AND count(*) - 1 AS commas FROM conversations WHERE role = 'user' GROUP BY conv_id)
      SELECT conv_id, runs, NOT sizes AND NOT commas AS agree, concat_ws(',', CASE WHEN commas THEN 'comma' END, CASE WHEN sizes THEN 'size' END) AS differing FROM c""",
    "tr16_comparator": "SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE toxic = 1) AS called FROM documents d LEFT JOIN labels l USING (doc_id)",
    "ge9_transform": f"WITH {ATOM_SQL} SELECT sid, idx, round(x * cos(sid) - y * sin(sid) + 1, 6) AS x, round(x * sin(sid) + y * cos(sid) + 2, 6) AS y, round(z + 3, 6) AS z FROM atom",
    "ge30_one_hot": f"""WITH {ATOM_SQL}, r(name, nth, p) AS (VALUES {", ".join(f"('{n}', {k}, {[float(v) for v in p]}::DOUBLE[])" for k, (n, p) in enumerate(RESIDUES.items()))}),
      f AS (SELECT sid, k, CASE WHEN idx % 3 = 2 OR nth IS NULL THEN 0.0::DOUBLE WHEN k < 20 THEN (k = nth)::INT::DOUBLE ELSE p[k - 19] END AS v FROM atom LEFT JOIN r ON name = res_name, unnest(range(0, 28)) AS t(k))
      SELECT sid, k::INT AS k, round(sum(v), 4) AS total FROM f GROUP BY ALL""",
    "ge44_chain_sequences": f"WITH {ATOM_SQL}, r AS (SELECT sid, chain_id, res_id, arg_min(res_name, idx) AS n FROM atom GROUP BY ALL) SELECT sid, chain_id, string_agg(CASE n WHEN 'ASP' THEN 'D' WHEN 'CYS' THEN 'C' ELSE 'H' END, '' ORDER BY res_id) AS sequence FROM r GROUP BY ALL",
}
