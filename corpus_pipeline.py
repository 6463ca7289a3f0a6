"""The corpus pipeline: five stages over ``documents``, each an operator of ``latticework.llm``.

Each stage takes all that its predecessor kept and returns the columns of documents (the last one the token
digest of each document).  ``run`` writes every stage's result as Parquet in the shared folder and reads it
again, so a lost executor never reaches back beyond one stage.

Null and empty texts leave in the first stage; very long texts are whole in every stage; rows that repeat an id
with different texts are documents of their own; an empty table runs through and gives no
rows.  Further columns, whatever they are called, come along up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm import bpe, common, decontaminate, exact_dedup, jaccard_join, language_id


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null texts and those without a letter.  Where ``lang`` is null, the language
    that was found takes its place."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model, carry=True).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id; of rows that repeat both
    id and text, one.  A null id stays only in a group without any other id."""
    kept = exact_dedup.exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text")).agg(F.count(F.lit(1)).alias("kept_rows"))
    kept = common.cut(kept, "kept")
    # By id and text, for rows without an id and rows that repeat one.
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (exact_dedup.text_digest(docs["text"]) == kept["kept_text"])
    return _one_of_each(docs, kept, same, ["kept_id", "kept_text"])


def _one_of_each(docs: DataFrame, kept: DataFrame, same: Column, key: list[str]) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names; where it names several rows alike (kept_rows), one of them."""
    if kept.where("kept_rows > 1").isEmpty():
        return docs.join(kept, same, "left_semi")
    found, row = docs.join(kept, same), f"row_{uuid.uuid4().hex}"
    again = Window.partitionBy(*(kept[c] for c in key)).orderBy(docs["text"])
    return found.withColumn(row, F.when(kept["kept_rows"] > 1, F.row_number().over(again)).otherwise(1)).where(F.col(row) == 1).select(*(docs[c] for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest id; where no row has an id, or
    several have that one, the one whose key is least; of rows that repeat both id and text, one.  Texts without words
    are linked with nothing, and stay."""
    found = common.cut(jaccard_join.jaccard_join(docs).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "component"), "linked")
    first = F.min(F.struct(F.col("kept_id").isNull().alias("none"), "kept_id", "kept_key", "kept_rows")).alias("first")
    each = found.where("component is not null").groupBy("component", "kept_id", "kept_key").agg(F.count(F.lit(1)).alias("kept_rows"))
    kept = each.groupBy("component").agg(first).select("first.kept_id", "first.kept_key", "first.kept_rows")
    kept = common.cut(kept.union(found.where("component is null").select("kept_id", "kept_key", F.lit(1)).distinct()), "kept")
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (jaccard_join.row_key(docs["doc_id"], docs["text"]) == kept["kept_key"])
    return _one_of_each(docs, kept, same, ["kept_id", "kept_key"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, benchmark, carry=True).where(~F.col("contaminated")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
