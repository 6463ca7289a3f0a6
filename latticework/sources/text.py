"""Text formats as DataFrames of lines, parsed with built-in functions.

A parser takes lines (path, line, value), so files of any number are read by Spark and nothing is parsed on the
driver; ``read_lines`` makes such lines from a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1 in each file), value.  A file is one record, so it is split where it was read."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("rows"))
    return whole.select("path", F.posexplode("rows").alias("n", "value")).select("path", (F.col("n") + 1).alias("line"), "value")


def stem(path: Column, suffix: str = ".pdb") -> Column:
    """Identifier of a file: its name without the literal suffix; dots and underscores inside stay."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def parse_pdb(lines: DataFrame) -> DataFrame:
    """SC2: atoms of the first model: alternate location blank or A, element from columns 77-78 or the name's
    first letter, occupancy 1 where it is blank."""
    kind = F.trim(F.substring("value", 1, 6))
    second = (kind == "MODEL") & (F.regexp_extract("value", r"^MODEL\s+(\d+)", 1).cast("int") > 1)
    stop = lines.where((kind == "ENDMDL") | second).groupBy("path").agg(F.min("line").alias("stop"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    rows = lines.where(kind.isin("ATOM", "HETATM")).join(stop, "path", "left").where(F.col("stop").isNull() | (F.col("line") < F.col("stop")))
    rows = rows.where(F.substring("value", 17, 1).isin(" ", "A", ""))
    name = cut(13, 4)
    letter = F.upper(F.regexp_extract(name, "([A-Za-z])", 1))
    element = F.coalesce(F.nullif(F.upper(cut(77, 2)), F.lit("")), letter)
    real = lambda a, n: F.nullif(cut(a, n), F.lit("")).cast("double")
    return rows.select(
        "path", "line", (kind == "HETATM").alias("hetero"), name.alias("atom_name"), cut(18, 3).alias("res_name"), cut(22, 1).alias("chain_id"), cut(23, 4).cast("int").alias("res_id"), cut(27, 1).alias("ins_code"),
        real(31, 8).alias("x"), real(39, 8).alias("y"), real(47, 8).alias("z"), F.coalesce(real(55, 6), F.lit(1.0)).alias("occupancy"), real(61, 6).alias("b_factor"), element.alias("element"),
    )


def scan_status(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """TR4: id, status, reason, n_atoms of every wanted structure.  Without lines it is ``no_structure_fetched``; with
    a coordinate that is no number ``unavailable``, and the reason names the first such line; else ``scored``."""
    atom = F.trim(F.substring("value", 1, 6)).isin("ATOM", "HETATM")
    numbers = [F.trim(F.substring("value", a, 8)).try_cast("double") for a in (31, 39, 47)]
    bad = atom & (numbers[0] + numbers[1] + numbers[2]).isNull()
    found = lines.groupBy(stem(F.col("path")).alias("id")).agg(F.min(F.when(bad, F.col("line"))).alias("bad"), F.count_if(atom).alias("n"))
    status = F.when(F.col("n").isNull(), "no_structure_fetched").when(F.col("bad").isNotNull(), "unavailable").otherwise("scored")
    reason = F.concat(F.lit("line "), F.col("bad").cast("string"), F.lit(": a coordinate is no number"))
    return ids.select("id").join(found, "id", "left").select("id", status.alias("status"), reason.alias("reason"), F.when(status == "scored", F.col("n")).alias("n_atoms"))


def template_fault(template_id: Column, wanted_id: Column, subclass: Column, wanted_subclass: Column, n_metals: Column) -> Column:
    """SC6: what is wrong with a two-metal template; null if nothing is."""
    return F.when(~template_id.eqNullSafe(wanted_id), "template_id differs").when(~subclass.eqNullSafe(wanted_subclass), "subclass differs").when(~n_metals.eqNullSafe(F.lit(2)), "a template has two metals")


def pdb_line(serial: Column, name: Column, res: Column, chain: Column, res_id: Column, x: Column, y: Column, z: Column, occupancy: Column, b: Column, element: Column) -> Column:
    """SK3: one fixed-width ATOM line."""
    return F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", serial, name, res, chain, res_id, x, y, z, occupancy, b, element)


def parse_pairs(lines: DataFrame, dialect: str = "sequence") -> DataFrame:
    """SC9: query, target, identity (0 to 1), coverage (the lesser), tm (the lesser; structure dialects only),
    line.  Self pairs go; a literal .pdb ending goes.  dialect: sequence, structure, pocket."""
    at = {"sequence": (4, None), "structure": (4, 6), "pocket": (5, 7)}[dialect]
    c = F.split("value", "\t")
    real = lambda k: c[k].cast("double")
    name = lambda k: F.regexp_replace(c[k], r"\.pdb$", "")
    out = lines.where(F.length("value") > 0).select(
        name(0).alias("query"), name(1).alias("target"), (real(2) / 100).alias("identity"), F.least(real(at[0]), real(at[0] + 1)).alias("coverage"),
        *([F.least(real(at[1]), real(at[1] + 1)).alias("tm")] if at[1] else []), "line",
    )
    return out.where("query <> target")


def last_of_pair(pairs: DataFrame, *scores: str) -> DataFrame:
    """The later line of a pair, in either direction, holds for both."""
    low = pairs.select(F.least("query", "target").alias("a"), F.greatest("query", "target").alias("b"), "line", *scores)
    return low.groupBy("a", "b").agg(*(F.max_by(s, "line").alias(s) for s in scores))


def parse_clusters(lines: DataFrame) -> DataFrame:
    """SC10: member, representative; the last line of a member holds."""
    c = F.split("value", "\t")
    rows = lines.where(F.length("value") > 0).select(c[0].alias("representative"), c[1].alias("member"), "line")
    return rows.groupBy("member").agg(F.max_by("representative", "line").alias("representative"))


def _once(value: Column) -> Column:
    """The value, as a generated row: conditions on it stay above and do not repeat what made it."""
    return F.explode(F.array(value))


def parse_domains(lines: DataFrame) -> DataFrame:
    """SC11: id, i_evalue, score, hmm and alignment ends of each domain; short lines raise."""
    made = lines.select(_once(F.col("value")).alias("value"), "line").where((F.length(F.trim("value")) > 0) & ~F.startswith("value", F.lit("#")))
    # One separator: a split at a single character needs no pattern, and Spark compiles a split's pattern for every row.
    rows = made.select(_once(F.split(F.regexp_replace(F.trim("value"), r"\s+", " "), " ")).alias("c"), "line")
    ok = F.when(F.size("c") >= 23, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("short domain line "), F.col("line").cast("string"))).cast("array<string>"))
    rows = rows.select(ok.alias("c"), "line")
    return rows.select(F.col("c")[0].alias("id"), F.col("c")[12].cast("double").alias("i_evalue"), F.col("c")[13].cast("double").alias("score"), *(F.col("c")[k].cast("int").alias(n) for k, n in ((15, "hmm_from"), (16, "hmm_to"), (17, "ali_from"), (18, "ali_to"))), "line")


def best_domain(ids: DataFrame, domains: DataFrame) -> DataFrame:
    """Every id with its best domain's score and number of domains; null and 0 without a hit."""
    g = domains.groupBy("id").agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_domains"))
    return ids.join(g, "id", "left").select("id", "best_score", F.coalesce("n_domains", F.lit(0)).alias("n_domains"))


def parse_fasta(records: DataFrame, whole_header: bool = False, upper: bool = False) -> DataFrame:
    """SC12: id, sequence of records (value: the text after each '>').  Ids are the header's first word."""
    head, body = F.split("value", "\n", 2)[0], F.regexp_replace(F.coalesce(F.try_element_at(F.split("value", "\n", 2), F.lit(2)), F.lit("")), r"\s", "")
    name = F.trim(head) if whole_header else F.split(F.trim(head), r"\s+")[0]
    return records.where(F.length(F.trim("value")) > 0).select(name.alias("id"), (F.upper(body) if upper else body).alias("sequence"))


def read_fasta(spark: SparkSession, path: str, **how) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", ">").text(path), **how)


def unique_ids(rows: DataFrame) -> DataFrame:
    """The rows, or an error where an id occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    checked = F.when(n == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col("id").cast("string"))))
    return rows.withColumn("id", checked)


def fasta_record(name: Column, sequence: Column) -> Column:
    """SK5: one record; null where the sequence is empty, which is not written."""
    return F.when(F.length(sequence) > 0, F.concat(F.lit(">"), name, F.lit("\n"), sequence, F.lit("\n")))


def parse_flag(value: Column) -> Column:
    """SC7: 1, true and yes, in any case."""
    return F.lower(F.trim(value)).isin("1", "true", "yes")


MANIFEST = "structure_id string, source_uri string, label string, tier int, subclass string, is_predicted string, is_reference_bank string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SC7: typed manifest; an empty subclass is null."""
    return typed_manifest(spark.read.schema(MANIFEST).csv(path, header=True))


def typed_manifest(rows: DataFrame) -> DataFrame:
    return rows.select("structure_id", "source_uri", "label", "tier", F.nullif(F.trim("subclass"), F.lit("")).alias("subclass"), parse_flag(F.col("is_predicted")).alias("is_predicted"), parse_flag(F.col("is_reference_bank")).alias("is_reference_bank"))


def pocket_score(lines: DataFrame) -> DataFrame:
    """SC21: the number after the last colon of the first line with 'Pocket Score'; null without one."""
    hit = F.when(F.contains("value", F.lit("Pocket Score")), F.element_at(F.split("value", ":"), -1).cast("double"))
    return lines.groupBy("path").agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("line"))).alias("score"))
