"""Pairs of boxes that overlap, within a key such as the image or the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import boxes as B


def _corners(df: DataFrame, box: str, p: str) -> DataFrame:
    """Corners and area as plain columns; boxes that can't overlap anything are left out before the join."""
    b = F.col(box)
    return df.where(B.whole(b) & (B.at(b, 2) > 0) & (B.at(b, 3) > 0)).withColumns(
        {f"{p}x0": B.at(b, 0), f"{p}y0": B.at(b, 1), f"{p}x1": B.at(b, 0) + B.at(b, 2), f"{p}y1": B.at(b, 1) + B.at(b, 3), f"{p}a": B.area_xywh(b)}
    )


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str, name: str = "iou", condition: Column | None = None) -> DataFrame:
    """Rows of both with equal keys whose xywh boxes overlap, with their IoU; columns other than the keys must
    differ. The overlap is a comparison of eight plain numbers in the join; arrays are opened once a row, not
    once a pair. A hot key is split by the adaptive skew join.

    A condition on the IoU moves into the join and may come before the overlap's, where boxes apart in both
    directions have an ``_inter`` of up to both areas and more; so the IoU itself refuses a union of 0."""
    pairs = _pairs(left, right, keys, left_box, right_box, condition)
    out = [c for c in left.columns] + [c for c in right.columns if c not in keys]
    union = F.col("_ra") + F.col("_la") - F.col("_inter")
    return pairs.where(union > 0).select(*out, F.when(union > 0, F.col("_inter") / union).alias(name))


def overlap_sums(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str, condition: Column | None = None) -> DataFrame:
    """The same pairs with ``inter``, and both areas as ``area_left`` and ``area_right``."""
    pairs = _pairs(left, right, keys, left_box, right_box, condition)
    out = [c for c in left.columns] + [c for c in right.columns if c not in keys]
    return pairs.select(*out, F.col("_inter").alias("inter"), F.col("_la").alias("area_left"), F.col("_ra").alias("area_right"))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str, condition: Column | None) -> DataFrame:
    a, b = _corners(left, left_box, "_l"), _corners(right, right_box, "_r")
    joined = a.join(b, keys)
    if condition is not None:
        joined = joined.where(condition)
    w = F.least("_lx1", "_rx1") - F.greatest("_lx0", "_rx0")
    h = F.least("_ly1", "_ry1") - F.greatest("_ly0", "_ry0")
    return joined.where((w > 0) & (h > 0)).withColumn("_inter", w * h)
