"""Ordered analytics: top-k, runs, look-ahead, saturating counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from maskloom.operators.grouped import spread


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, ranked from 1; limited in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def match_runs(df: DataFrame, groups: list[str], at: str, matched: Column, name: str = "run") -> DataFrame:
    """Length of the current run of consecutive matches, 0 on a miss."""
    line = Window.partitionBy(*groups).orderBy(at)
    island = df.withColumn("_m", F.coalesce(matched, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(line))
    within = Window.partitionBy(*groups, "_island").orderBy(at)
    return island.withColumn(name, F.sum(F.when(F.col("_m"), 1).otherwise(0)).over(within)).drop("_m", "_island")


def confirmed(df: DataFrame, groups: list[str], at: str, run: str, needed: int) -> DataFrame:
    """Whether a run of ``needed`` was ever reached so far."""
    line = Window.partitionBy(*groups).orderBy(at)
    return df.withColumn("confirmed", F.coalesce(F.max(run).over(line) >= needed, F.lit(False)))


def look_ahead(df: DataFrame, groups: list[str], at: str, value: str, k: int, name: str) -> DataFrame:
    """The value k rows later, or the last one where there are fewer."""
    line = Window.partitionBy(*groups).orderBy(at)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    position = F.row_number().over(line)
    out = df.withColumn("_last", position + k > F.count(F.lit(1)).over(whole))
    return out.withColumn(name, F.when(F.col("_last"), F.last(value).over(whole)).otherwise(F.lead(value, k).over(line))).drop("_last")


def carried_forward(df: DataFrame, groups: list[str], at: str, condition: Column, name: str) -> DataFrame:
    """The last ``at`` so far on which the condition held."""
    line = Window.partitionBy(*groups).orderBy(at)
    return df.withColumn(name, F.last(F.when(condition, F.col(at)), ignorenulls=True).over(line))


def strided(df: DataFrame, groups: list[str], at: str, begin: int, end: int, stride: int) -> DataFrame:
    """Rows begin, begin + stride, ... up to end of each group, counted from 0."""
    rn = F.row_number().over(Window.partitionBy(*groups).orderBy(at)) - 1
    return df.withColumn("_rn", rn).where((F.col("_rn") >= begin) & (F.col("_rn") <= end) & ((F.col("_rn") - begin) % stride == 0)).drop("_rn")


def keep_alive(df: DataFrame, groups: list[str], at: str, matched: Column, start: int, low: int, high: int) -> DataFrame:
    """A counter from ``start``, +1 on a match, -1 on a miss, kept in [low, high] at every step.

    The clamp depends on the path, so this is a fold over a group's ordered flags. Rows are streamed in order with one
    number of state, so a group of any length takes time in proportion and no memory; it is one task's work.
    """
    hit = F.coalesce(matched, F.lit(False))
    flags = df.select(*groups, F.col(at), hit.alias("_hit"))
    columns = [*groups, at]
    schema = df.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c = None, start
        for b in batches:
            keys = list(zip(*(b.column(g).to_pylist() for g in groups), strict=True)) if groups else [()] * b.num_rows
            out = []
            for k, h in zip(keys, b.column("_hit").to_pylist(), strict=True):
                if k != key:
                    key, c = k, start
                c = min(c + 1, high) if h else max(c - 1, low)
                out.append(c)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in columns), pa.array(out, pa.int32())], names=[*columns, "alive"])

    ordered = spread(flags, groups).sortWithinPartitions(*columns)
    return ordered.mapInArrow(run, StructType([*schema.fields, StructField("alive", IntegerType())]))


def first_and_last(df: DataFrame, groups: list[str], at: str, value: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def best_label(scores: Column) -> Column:
    """Index of the largest number, the first one if equal."""
    top = F.array_max(scores)
    return (F.array_position(scores, top) - 1).cast("int")
