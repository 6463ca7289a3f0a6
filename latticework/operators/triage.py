"""Filters, validation and triage: what passes, what is refused, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("positive", "hard_negative", "easy_negative", "unlabeled")


def composition(text: Column, floors: dict[str, int]) -> Column:
    """FI5: each letter occurs at least so often."""
    ok = F.lit(True)
    for letter, n in floors.items():
        ok = ok & (F.length(text) - F.length(F.replace(text, F.lit(letter))) >= n)
    return ok


def hash_sample(key: Column, rate: float) -> Column:
    """FI6: the first 32 bits of the key's SHA-256, as a share, lie strictly under the rate."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0 < rate


def exclude(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """FI7: rows whose key is in none of the others (their first columns)."""
    ids = None
    for o in others:
        one = o.select(F.col(o.columns[0]).alias(key))
        ids = one if ids is None else ids.union(one)
    return rows.join(ids.distinct(), key, "left_anti")


def map_or_fail(value: Column, mapping: dict[str, object], what: str) -> Column:
    """FI8: mapped value; an unknown one raises."""
    cases = [F.when(value == k, F.lit(v)) for k, v in mapping.items()]
    return F.coalesce(*cases, F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))))


def validate_manifest(rows: DataFrame) -> DataFrame:
    """FI9: id, violation, for duplicate ids, bad tiers and labels, reference members that are not positive and
    positives without a subclass.  rows: id, label, tier, subclass, is_reference."""
    dup = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("violation"))
    rules = F.array(
        F.when(~F.coalesce(F.col("tier").between(1, 4), F.lit(False)), "invalid_tier"), F.when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "invalid_label"),
        F.when(F.col("is_reference") & (F.col("label") != "positive"), "reference_not_positive"), F.when((F.col("label") == "positive") & F.col("subclass").isNull(), "positive_without_subclass"),
    )
    return dup.union(rows.select("id", F.explode(F.array_compact(rules)).alias("violation")))


def compare_ids(want: DataFrame, have: DataFrame) -> DataFrame:
    """FI10: side (missing or extra), n, and the first five examples in order."""
    j = want.select("id", F.lit(1).alias("w")).distinct().join(have.select("id", F.lit(1).alias("h")).distinct(), "id", "full_outer")
    side = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "extra")
    rows = j.select("id", side.alias("side")).where("side is not null")
    from pyspark.sql import Window

    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("side").orderBy("id"))).where("r <= 5")
    examples = first.groupBy("side").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("examples"))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).join(examples, "side")


def two_channel(structural: Column, retrieval: Column) -> Column:
    """TR1: missing is never negative."""
    s, r = F.coalesce(structural == "supported", F.lit(False)), F.coalesce(retrieval == "positive", F.lit(False))
    return F.when(s & r, "dual_support").when(s, "structure_only").when(r, "retrieval_only").otherwise("unresolved")


def broad_shortlist(call: Column, confidence: Column, hit: Column, retrieval: Column) -> Column:
    """TR2: called, confident, no profile hit, and not retrieved as positive (unavailable passes)."""
    return F.coalesce(call, F.lit(False)) & F.coalesce(confidence >= 70, F.lit(False)) & ~F.coalesce(hit, F.lit(False)) & F.coalesce(retrieval != "positive", F.lit(True))


def triplet_loss(rows: DataFrame, margin: float) -> DataFrame:
    """TR9: weighted mean of relu(margin + d_ap - d_an), weights the lesser of the two tiers'.
    rows: d_ap, d_an, w_anchor, w_positive."""
    w = F.least("w_anchor", "w_positive")
    loss = F.greatest(F.lit(0.0), F.lit(margin) + F.col("d_ap") - F.col("d_an"))
    return rows.agg((F.sum(w * loss) / F.greatest(F.sum(w), F.lit(1e-8))).alias("loss"))


def agreeing_settings(runs: DataFrame, key: str, settings: str, free: tuple[str, ...] = ("seed", "loss")) -> DataFrame:
    """TR15: key, runs, agree, differing: whether the settings (a map of strings) of all runs of a key are the same but
    for the free ones, and the names of those that are not, sorted.  A setting that some runs lack differs."""
    each = runs.select(key, F.explode(F.map_filter(settings, lambda k, v: ~k.isin(*free))).alias("name", "value"))
    named = each.groupBy(key, "name").agg(F.count(F.lit(1)).alias("held"), F.min(F.coalesce("value", F.lit("null"))).alias("low"), F.max(F.coalesce("value", F.lit("null"))).alias("high"))
    sizes = runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"))
    odd = named.join(sizes, key).where((F.col("low") != F.col("high")) | (F.col("held") < F.col("runs"))).groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("names"))
    out = sizes.join(odd, key, "left")
    return out.select(key, "runs", F.col("names").isNull().alias("agree"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("differing"))
