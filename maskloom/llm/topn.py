"""The N best items of every group, by descending score bands.

Band edges are quantiles of all scores. The rows are written once, partitioned by band, without a shuffle, and the
bands read from the top. Of a band each task keeps the first N (score, id) of a group, copies included, before
anything is moved; the rows are salted, so the rows of a group, also copies of one item, are spread over ``SALTS``
tasks and at most N items a salt go on. Then copies become one row, and the exact ranking (score downwards, id
upwards) fills what the groups still lack. Groups that bands above have filled are taken out by an anti join: before
the limit while they are few enough to be broadcast, after it if not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from maskloom.shared import materialize

BANDS = (0.9, 0.6)  #: quantiles between the bands, from the top
SALTS = 8
BROADCAST_GROUPS = 500_000  #: integer keys of filled groups that may be broadcast


def _first(part: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items of each group and salt, with their copies; limited in each task before the shuffle."""
    salted = part.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    order = Window.partitionBy("group", "_salt").orderBy(F.col("score").desc(), "id")
    return salted.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= n).drop("_rank", "_salt")


def _items(part: DataFrame, n: int) -> DataFrame:
    """One row an item of those that can be among the first ``n`` of their group in this band: group, id, score."""
    best = materialize(_first(part, n).groupBy("group", "id").agg(F.max("score").alias("score"), F.min("score").alias("_least")), "items")
    mixed = best.where("_least < score").select("group").distinct()
    best = best.drop("_least")
    if not mixed.head(1):
        return best
    # an item with several scores took several places: these groups are ranked without a limit per task
    whole = part.join(mixed, "group", "left_semi").groupBy("group", "id").agg(F.max("score").alias("score"))
    return best.join(mixed, "group", "left_anti").unionByName(whole)


def top_n(rows: DataFrame, n: int = 5, bands: tuple[float, ...] = BANDS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The first ``n`` of each group: group, id, score, rank; ``rows`` has group, id, score.

    Defined cases: null groups, null and NaN scores and null ids are no candidates; copies of an id count
    once per group, with the highest score should they differ; -0.0 equals 0.0; equal scores go by id
    upwards; infinite scores are ordinary; groups of fewer than ``n`` items come whole.
    """
    valid = rows.where(F.col("group").isNotNull() & F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    valid = valid.select("group", "id", (F.col("score") + F.lit(0.0)).alias("score"))
    edges = valid.agg(F.percentile_approx("score", list(bands), 1000)).first()[0] or []  # as many numbers as bands
    band = reduce(lambda c, e: c + F.when(F.col("score") < F.lit(e), 1).otherwise(0), sorted(set(edges)), F.lit(0))
    banded = materialize(valid.withColumn("band", band), "bands", ("band",))
    integers = isinstance(valid.schema["group"].dataType, IntegralType)
    by_score = Window.partitionBy("group").orderBy(F.col("score").desc(), "id")
    found: DataFrame | None = None
    have: DataFrame | None = None  # group, have: places taken by the bands above
    for b in range(len(set(edges)) + 1):
        part = banded.where(F.col("band") == b).select("group", "id", "score")
        if found is None:
            ranked = _items(part, n).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)
        else:
            filled = have.where(F.col("have") >= n).select("group")
            few = integers and filled.count() <= broadcast_groups
            if few:
                part = part.join(F.broadcast(filled), "group", "left_anti")
            items = _items(part, n)
            if not few:
                items = items.join(filled, "group", "left_anti")
            items = items.join(found.select("group", "id"), ["group", "id"], "left_anti")  # copies with a lower score
            ranked = items.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)
            ranked = ranked.join(have, "group", "left").withColumn("rank", F.col("rank") + F.coalesce("have", F.lit(0))).where(F.col("rank") <= n)
        kept = materialize(ranked.select("group", "id", "score", F.col("rank").cast("int")), "band")
        more = kept.groupBy("group").agg(F.count(F.lit(1)).cast("int").alias("have"))
        have = more if have is None else have.unionByName(more).groupBy("group").agg(F.sum("have").cast("int").alias("have"))
        have = materialize(have, "filled")
        found = kept if found is None else found.unionByName(kept)
    return found
