"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

1. ``heavy_keys`` finds the keys that can hold ``share`` of the rows, with a frequent-items sketch: at
   most ``1 / (share - error)`` keys come to the driver, none that is heavy is missed.
2. Rows of these keys get a random salt, all others salt 0. Stage one aggregates per (key, salt), stage
   two merges the partial results per key. No task ever gets more than one salt of a heavy key, also for
   what can't be combined before the shuffle, such as distinct counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

TRACKED = 16_384  #: counters of the sketch; its error is at most 3.5 / TRACKED of the rows


@dataclass(frozen=True)
class Mergeable:
    """An aggregate as partial results and their merge: both give one column ``name``."""

    name: str
    partial: Callable[[], Column]
    merge: Callable[[Column], Column]


def rows(name: str) -> Mergeable:
    return Mergeable(name, lambda: F.count(F.lit(1)), F.sum)


def non_null(name: str, value: Column) -> Mergeable:
    return Mergeable(name, lambda: F.count(value), F.sum)


def total(name: str, value: Column) -> Mergeable:
    return Mergeable(name, lambda: F.sum(value), F.sum)


def least(name: str, value: Column) -> Mergeable:
    return Mergeable(name, lambda: F.min(value), F.min)


def most(name: str, value: Column) -> Mergeable:
    return Mergeable(name, lambda: F.max(value), F.max)


def heavy_keys(df: DataFrame, group: str, key: str, share: float) -> list[tuple]:
    """(group, key) pairs that can hold at least ``share`` of their group's rows; ``group`` is a small
    dimension such as a table name. A superset by the sketch's error, bounded by 1 / (share - error)."""
    slack = 3.5 / TRACKED
    if share <= 2 * slack:
        raise ValueError(f"share must be over {2 * slack}")
    k = int(1 / (share - slack)) + 2  # null counts as an item
    top = F.expr(f"approx_top_k(`{key}`, {k}, {TRACKED})")
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
    found = per_group.select(group, "n", F.inline("top"))
    return [(r[0], r["item"]) for r in found.where(F.col("count") >= (share - slack) * F.col("n")).where(F.col("item").isNotNull()).collect()]


def salted_aggregate(df: DataFrame, group: str, key: str, aggregates: list[Mergeable], share: float = 0.01, salts: int = 64, distinct: tuple[str, str] | None = None) -> DataFrame:
    """``aggregates`` per (group, key): heavy keys are salted, partial results merged.

    ``distinct=(name, column)`` adds the number of distinct non-null values; its salt is a hash of the
    value, so that equal values meet in one salt, and counts of salts add up.

    Defined cases: null keys form a group of their own (the sketch takes none, partial aggregation before
    the shuffle reduces them like all others); an empty input gives no rows; ties and repeated rows are
    counted as they come; columns of other names are ignored.
    """
    heavy = heavy_keys(df, group, key, share)
    is_heavy = F.lit(False)
    for g in dict.fromkeys(g for g, _ in heavy):
        is_heavy = is_heavy | ((F.col(group) == g) & F.col(key).isin([k for h, k in heavy if h == g]))
    is_heavy = F.coalesce(is_heavy, F.lit(True))  # null keys are salted too: there may be any number
    # by the row itself, so that a task run again gives its rows the same salts; equal rows by their place
    plain = [F.col(f"`{c.name}`") for c in df.schema if not isinstance(c.dataType, MapType)]
    draw = F.pmod(F.xxhash64(*plain, F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    salted = df.withColumn("_salt", F.when(is_heavy, draw).otherwise(0))
    partial = salted.groupBy(group, key, "_salt").agg(*(a.partial().alias(a.name) for a in aggregates))
    merged = partial.groupBy(group, key).agg(*(a.merge(F.col(a.name)).alias(a.name) for a in aggregates))
    if distinct is None:
        return merged
    name, column = distinct
    by_value = df.where(F.col(column).isNotNull()).withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")).otherwise(0))
    once = by_value.groupBy(group, key, "_salt", column).agg(F.lit(1).alias("_one"))
    counts = once.groupBy(group, key, "_salt").agg(F.count(F.lit(1)).alias(name)).groupBy(group, key).agg(F.sum(name).alias(name))
    counts = counts.withColumnsRenamed({group: "_g", key: "_k"})
    joined = merged.join(counts, (F.col(group) == F.col("_g")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(*merged.columns, F.coalesce(name, F.lit(0).cast("long")).alias(name))


def over_share(df: DataFrame, group: str, key: str, percent: int) -> DataFrame:
    """(group, key) with at least ``percent`` % of all rows of the group, rows with a null key included."""
    per_key = salted_aggregate(df, group, key, [rows("n_rows")], share=percent / 100)
    totals = per_key.groupBy(group).agg(F.sum("n_rows").alias("n_all"))  # one row per group, from the same partial results
    joined = per_key.join(F.broadcast(totals), group)
    # one condition: a null check of its own would be pushed below the aggregation, which then runs twice
    over = F.when(F.col(key).isNull(), False).otherwise(F.col("n_rows") * 100 >= F.col("n_all") * percent)
    return joined.where(over).select(group, key, "n_rows", "n_all")
