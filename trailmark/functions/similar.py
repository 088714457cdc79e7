"""Similarity of short labels: bigrams and edits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MARGIN = 0.85, 0.10


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams, as often as both have them, over all bigrams."""
    x, y = bigrams(a), bigrams(b)
    times = lambda xs, g: F.size(F.filter(xs, lambda h: h == g))
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(times(x, g), times(y, g)))
    return F.when(a == b, 1.0).when(F.size(x) + F.size(y) > 0, 2 * shared / (F.size(x) + F.size(y))).otherwise(0.0)


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(dice(a, b), edit_ratio(a, b))


def best_labels(df: DataFrame, keys: list[str], candidate: str, labels: list[tuple[str, str]]) -> DataFrame:
    """(keys, value): for each row of ``df``, told apart by ``keys``, the value of the (label, value) most like ``candidate``.

    Rows whose best label is below LEAST, or not ahead of another value's by MARGIN, are left out.
    """
    options = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(value).alias("value")) for label, value in labels])
    # files repeat each other's labels, so each is compared once
    asked = df.where(F.col(candidate) != "").select(*keys, F.col(candidate).alias("_candidate"))
    each = asked.select("_candidate").distinct().select("_candidate", F.explode(options).alias("_o"))
    scored = each.select("_candidate", F.col("_o.value").alias("value"), similarity(F.col("_candidate"), F.col("_o.label")).alias("_score"))
    by_value = scored.groupBy("_candidate", "value").agg(F.max("_score").alias("_score")).where(F.col("_score") >= LEAST)
    ranked = by_value.groupBy("_candidate").agg(F.array_sort(F.collect_list(F.struct((-F.col("_score")).alias("minus"), "value"))).alias("_r"))
    second = F.get("_r", F.lit(1))["minus"]
    clear = second.isNull() | (second - F.get("_r", F.lit(0))["minus"] >= MARGIN)
    best = ranked.where(clear).select("_candidate", F.get("_r", F.lit(0))["value"].alias("value"))
    return asked.join(best, "_candidate").select(*keys, "value")
