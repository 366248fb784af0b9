"""One-to-one and one-to-many matching.

Optimal assignment works on sparse pairs of positive similarity: pairs at 0 add nothing to the total. A row
with k rivals needs only its k best partners, so each left item keeps that many, which bounds a group by
the square of its smaller side, however many partners a hot one has. Groups whose left items all have
different best partners are settled without Python; only the others reach the algorithm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.operators.grouped import map_groups


def hungarian(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight, as many as the smaller side has. Shortest augmenting
    paths with potentials; ties go to the smallest index."""
    w = np.asarray(weights, float)
    if w.size == 0:
        return []
    flipped = w.shape[0] > w.shape[1]
    cost = -(w.T if flipped else w)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[int(np.argmin(least[free]))]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0], j0 = owner[j1], j1
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) for r, c in pairs) if flipped else sorted(pairs)


def _assign_groups(rows: pa.Table, bounds: list[int]) -> pa.Table:
    left, right, weights = (rows.column(c).to_numpy() for c in ("left", "right", "weight"))
    picked: list[int] = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        _, i = np.unique(left[a:b], return_inverse=True)
        _, j = np.unique(right[a:b], return_inverse=True)
        weight, place = np.zeros((i.max() + 1, j.max() + 1)), np.full((i.max() + 1, j.max() + 1), -1)
        weight[i, j], place[i, j] = weights[a:b], np.arange(a, b)
        picked += [int(place[p]) for p in hungarian(weight) if place[p] >= 0]
    return rows.take(pa.array(sorted(picked), pa.int64()))


def assign(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """The pairs of an optimal one-to-one assignment per group: those rows of ``pairs``.

    ``pairs`` has groups, left, right (BIGINT), weight (to maximise in total) and any other columns; rows of
    weight null, NaN or <= 0 are left out, as they add nothing. Equal totals: deterministic, smallest ids first
    where the algorithm has a choice. Each (left, right) must occur once in a group.
    """
    positive = pairs.where((F.col("weight") > 0) & ~F.isnan("weight"))
    by_left = Window.partitionBy(*groups, "left").orderBy(F.col("weight").desc(), "right")
    sizes = positive.groupBy(*groups).agg(F.count_distinct("left").alias("_n"))
    ranked = positive.withColumn("_k", F.row_number().over(by_left)).join(sizes, groups).where(F.col("_k") <= F.col("_n"))
    best = ranked.where("_k = 1").groupBy(*groups).agg(F.count_distinct("right").alias("_r"))
    judged = ranked.join(best, groups)
    easy = judged.where("_r = _n AND _k = 1").select(*pairs.columns)
    hard = judged.where("_r < _n").select(*pairs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return easy.unionByName(map_groups(hard, groups, _assign_groups, schema, ["left", "right"]))


def detr_weight(probability: Column, l1: Column, giou: Column, class_weight: float = 1.0, box_weight: float = 5.0, giou_weight: float = 2.0, focal: bool = False, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """What ``assign`` maximises for the matching cost of a query and a target: minus (class + L1 box +
    GIoU costs), moved up by a constant so that it is positive."""
    if focal:
        positive = alpha * F.pow(1 - probability, F.lit(gamma)) * -F.ln(probability + 1e-8)
        negative = (1 - alpha) * F.pow(probability, F.lit(gamma)) * -F.ln(1 - probability + 1e-8)
        class_cost = positive - negative
    else:
        class_cost = -probability
    return 1000.0 - (class_weight * class_cost + box_weight * l1 - giou_weight * giou)


def one_to_many(pairs: DataFrame, groups: list[str], alpha: float = 0.3, quantile: float = 0.9, threshold: float = 0.4) -> DataFrame:
    """Detections of each target whose score alpha * probability + (1 - alpha) * iou is over the target's
    quantile and over ``threshold``. ``pairs`` has groups, detection, target, probability, iou."""
    scored = pairs.withColumn("match_score", alpha * F.col("probability") + (1 - alpha) * F.col("iou"))
    cut = scored.groupBy(*groups, "target").agg(F.percentile("match_score", quantile).alias("cut"))
    return scored.join(cut, [*groups, "target"]).where((F.col("match_score") > F.col("cut")) & (F.col("match_score") > threshold)).drop("cut")


def associate(detections: DataFrame, tracks: DataFrame, pairs: DataFrame, assoc: float = 0.1, track_assoc: float = 0.5, new_score: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Detections with their matched tracks and whether they begin a new one; tracks with whether they are
    unmatched. ``detections``: frame, det, score; ``tracks``: frame, track; ``pairs``: frame, det, track, iou.

    A detection has all tracks of IoU >= ``assoc``; it is new if it has none and its score is at least
    ``new_score``. A track is unmatched without a detection of IoU >= ``track_assoc``.
    """
    per_det = pairs.where(F.col("iou") >= assoc).groupBy("frame", "det").agg(F.array_sort(F.collect_set("track")).alias("tracks"))
    dets = detections.join(per_det, ["frame", "det"], "left").withColumn("is_new", F.coalesce((F.col("score") >= new_score) & F.col("tracks").isNull(), F.lit(False)))
    per_track = pairs.where(F.col("iou") >= track_assoc).select("frame", "track").distinct().withColumn("matched", F.lit(True))
    trks = tracks.join(per_track, ["frame", "track"], "left").select("frame", "track", F.col("matched").isNull().alias("is_unmatched"))
    return dets.select("frame", "det", F.coalesce("tracks", F.array().cast("array<bigint>")).alias("tracks"), "is_new"), trks


def _greedy_groups(rows: pa.Table, bounds: list[int]) -> pa.Table:
    det, gt, iou = (rows.column(c).to_pylist() for c in ("det", "gt", "iou"))  # in order of score
    picked = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        by_det: dict[int, list[int]] = {}
        for n in range(a, b):
            by_det.setdefault(det[n], []).append(n)
        taken: set[int] = set()
        for own in by_det.values():
            if free := [n for n in own if gt[n] not in taken]:
                best = max(free, key=lambda n: (iou[n], -gt[n]))
                taken.add(gt[best])
                picked.append(best)
    return rows.take(pa.array(picked, pa.int64()))


def greedy_by_score(pairs: DataFrame, groups: list[str], thresholds: list[float]) -> DataFrame:
    """Score-ordered greedy matching at each threshold: groups, thr_idx, det, gt, iou.

    ``pairs``: groups, det, score, gt, iou. In order of score (equal: smaller det), a detection takes the free
    target of greatest IoU >= threshold (equal: smaller gt). Of n targets, one is surely taken by one of its n
    best-scoring candidates, so only these are kept, which bounds a group by n squared. Where no detection
    has two targets, each target's best-scoring candidate is the match; only other groups go to Python.
    """
    at = F.posexplode(F.array(*(F.lit(t) for t in thresholds))).alias("thr_idx", "thr")
    near = pairs.where(F.col("iou") >= min(thresholds)).select(*groups, "det", "score", "gt", "iou", at).where(F.col("iou") >= F.col("thr")).drop("thr")
    unit = [*groups, "thr_idx"]
    score = F.coalesce(F.nanvl("score", F.lit(float("-inf"))), F.lit(float("-inf")))
    by_gt = Window.partitionBy(*unit, "gt").orderBy(score.desc(), "det")
    sizes = near.groupBy(*unit).agg(F.count_distinct("gt").alias("_n"), (F.count("det") == F.count_distinct("det")).alias("_easy"))
    ranked = near.withColumn("_k", F.row_number().over(by_gt)).join(sizes, unit).where(F.col("_k") <= F.col("_n"))
    out = [*unit, "det", "gt", "iou"]
    easy = ranked.where("_easy AND _k = 1").select(*out)
    hard = ranked.where("NOT _easy").withColumn("_o", -score).select(*out, "_o")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hard.schema.fields)
    return easy.unionByName(map_groups(hard, unit, _greedy_groups, schema, ["_o", "det"]).select(*out))
