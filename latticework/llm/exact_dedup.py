"""Operator 10: exact deduplication.

Texts are equal when they are identical after lower-casing A-Z.  Rows are grouped by a 128-bit content
hash *and* the text itself, so the aggregation compares bytes wherever hashes meet and a collision
cannot join two texts.  Spark aggregates before it shuffles: a group of any size leaves each task as
one row.  Members find their group again by both digests, a join on short keys that adaptive execution
may split where one group holds much of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _norm(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_digest(text: Column) -> Column:
    """``text_sha256`` of a text."""
    return F.sha2(_norm(text), 256)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group stays (the stable choice asked for by the query).  Null text
    counts as empty, so empty and null texts form one group.  Rows that repeat one id with one text each
    give a row and are kept alike; a null id stays only in a group without any other id.  An empty table
    gives no rows.  Columns of the input besides the two named are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _norm(F.col(text)).alias("norm"))
    groups = (
        rows.groupBy(F.unhex(F.md5("norm")).alias("h"), "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    return members.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
