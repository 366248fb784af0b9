"""Aggregates of evaluation: weighted and conditional means, roll-ups of additive counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value * weight) / max(1, sum(weight))."""
    return F.sum(value * weight) / F.greatest(F.lit(1.0), F.sum(weight))


def mean_of_defined(value: Column, undefined: float = -1.0) -> Column:
    """Mean without the values that stand for undefined; undefined if nothing is left."""
    return F.coalesce(F.avg(F.nullif(value, F.lit(undefined))), F.lit(undefined))


def roll_up(df: DataFrame, seq: str, cls: str, counters: list[str]) -> DataFrame:
    """Sums of the counters per (sequence, class), per class over all sequences, and over everything, in one
    aggregation; ``level`` is 0, 2 (sequence rolled up) or 3 (both)."""
    sums = ", ".join(f"sum(`{c}`) AS `{c}`" for c in counters)
    return df.sparkSession.sql(
        f"SELECT `{seq}`, `{cls}`, CAST(grouping_id(`{seq}`, `{cls}`) AS INT) AS level, {sums} FROM {{df}} GROUP BY GROUPING SETS ((`{seq}`, `{cls}`), (`{cls}`), ())", df=df
    )


def class_mean(df: DataFrame, values: list[str], empty: Column | None = None) -> DataFrame:
    """Unweighted mean over class rows, without those that are ``empty``."""
    kept = df if empty is None else df.where(~empty)
    return kept.agg(*(F.avg(v).alias(v) for v in values))


def majority(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """The most frequent label of a group (equal: the smallest) and its mean score."""
    per = df.where(F.col(label).isNotNull()).groupBy(*groups, label).agg(F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_s"), F.count(score).alias("_c"))
    best = per.groupBy(*groups).agg(F.max(F.struct("_n", (-F.col(label)).alias("_l"))).alias("_b"), F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    return best.select(*groups, (-F.col("_b._l")).alias(label), F.try_divide("_s", "_c").alias(f"mean_{score}"))


def mean_area_with_zeros(areas: Column) -> Column:
    """Mean over all frames, absent ones as 0."""
    return F.try_divide(F.aggregate(areas, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), F.nullif(F.size(areas), F.lit(0)).cast("double"))


def mean_area_present(areas: Column) -> Column:
    """Mean over the frames that have an area; null without any."""
    own = F.filter(areas, lambda v: F.coalesce(v, F.lit(0.0)) > 0)
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, v: s + v), F.nullif(F.size(own), F.lit(0)).cast("double"))


def one_row(df: DataFrame, what: str) -> DataFrame:
    """The rows, or an error when reading if there isn't exactly one."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.assert_true(F.col("n") == 1, F.concat(F.lit(f"{what}: rows "), F.col("n").cast("string"))).alias("ok"), "n")
