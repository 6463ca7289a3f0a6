"""Evaluation metrics.  Calls: method, id, truth (boolean), status (supported, not_supported, unavailable).

Three conventions for empty denominators exist side by side and are not unified: null, one, or mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(call: Column, truth: Column) -> list[Column]:
    """tp, tn, fp, fn as aggregates; a null call counts as no call."""
    y = F.coalesce(call, F.lit(False))
    return [F.count_if(truth & y).alias("tp"), F.count_if(~truth & ~y).alias("tn"), F.count_if(~truth & y).alias("fp"), F.count_if(truth & ~y).alias("fn")]


def _rates(sens: Column, spec: Column, digits: int) -> list[Column]:
    return [F.round(sens, digits).alias("sensitivity"), F.round(spec, digits).alias("specificity"), F.round((sens + spec) / 2, digits).alias("balanced_accuracy")]


def _over(a: str, b: str, zero: str) -> Column:
    n = F.col(a) + F.col(b)
    return F.try_divide(F.col(a), n) if zero == "null" else F.col(a) / F.greatest(n, F.lit(1))


def rates(counts: DataFrame, keys: list[str], convention: str = "null", digits: int = 6) -> DataFrame:
    """MT1 (``null``), MT2 (``one``) and MT3 (``mixed``: null sensitivity, specificity over at least one)."""
    sens = _over("tp", "fn", "null" if convention in ("null", "mixed") else "one")
    spec = _over("tn", "fp", "null" if convention == "null" else "one")
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    more = [F.round((F.col("tp") + F.col("tn")) / F.greatest(n, F.lit(1)), digits).alias("accuracy")] if convention == "one" else []
    return counts.select(*keys, "tp", "tn", "fp", "fn", n.alias("n"), *_rates(sens, spec, digits), *more)


def abstaining(calls: DataFrame, *keys: str) -> DataFrame:
    """MT4: unavailable stays out of tp..fn; evaluable share, end-to-end sensitivity, fp over all negatives."""
    here = F.col("status") != "unavailable"
    y, t = F.col("status") == "supported", F.col("truth")
    g = calls.groupBy(*keys).agg(
        F.count_if(here & t & y).alias("tp"), F.count_if(here & ~t & ~y).alias("tn"), F.count_if(here & ~t & y).alias("fp"), F.count_if(here & t & ~y).alias("fn"),
        F.count_if(t).alias("n_positive"), F.count_if(~t).alias("n_negative"), F.avg(here.cast("int")).alias("e"),
    )
    return g.select(*keys, "tp", "tn", "fp", "fn", F.round("e", 6).alias("evaluable"), F.round(F.try_divide("tp", "n_positive"), 6).alias("end_to_end"), F.round(F.try_divide("fp", "n_negative"), 6).alias("false_rate"))


def by_population(calls: DataFrame, members: DataFrame) -> DataFrame:
    """MT5: methods x overlapping populations.  members: population, id."""
    j = calls.join(members, "id")
    return rates(j.groupBy("method", "population").agg(*confusion(F.col("status") == "supported", F.col("truth"))), ["method", "population"])


def false_by_family(calls: DataFrame, *keys: str) -> DataFrame:
    """MT7: negatives by family (empty is ``unknown``): n, false positives and their rate, unavailable."""
    fam = F.coalesce(F.nullif(F.col("family"), F.lit("")), F.lit("unknown"))
    y = F.col("status") == "supported"
    return calls.where(~F.col("truth")).groupBy(*keys, fam.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("fp"), F.round(F.avg(y.cast("int")), 6).alias("rate"), F.count_if(F.col("status") == "unavailable").alias("n_unavailable"))


def recovered(calls: DataFrame, baseline: str, other: str) -> DataFrame:
    """MT8: positives that the baseline misses and the other method calls."""
    c = calls.where("truth").groupBy("id").agg(*(F.bool_or((F.col("method") == m) & (F.col("status") == "supported")).alias(n) for m, n in ((baseline, "a"), (other, "b"))))
    return c.where("b and not a").select("id")
