"""Greedy suppression: of overlapping items, the best-scoring stays.

Greedy suppression is sequential within a group, but what was kept is little. So a group is worked off in
rounds: the best ``chunk`` undecided items of every group are decided one after the other, then all rows left
are held against what was kept, in parallel and without moving them. A group of any size thus sends
``chunk`` rows a round to one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.functions import boxes as B
from maskloom.operators.grouped import map_groups
from maskloom.shared import materialize

CHUNK = 2048
BROADCAST_ROWS = 200_000  #: kept boxes (5 numbers each) that may be broadcast; more are shuffled


def overlap_matrix(box: np.ndarray, others: np.ndarray, measure: str) -> np.ndarray:
    """IoU or IoM of one xywh box with others."""
    w = np.minimum(box[0] + box[2], others[:, 0] + others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[1] + box[3], others[:, 1] + others[:, 3]) - np.maximum(box[1], others[:, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    a, b = box[2] * box[3], others[:, 2] * others[:, 3]
    whole = np.minimum(a, b) if measure == "iom" else a + b - inter
    return np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0)


def greedy(boxes: np.ndarray, threshold: float, inclusive: bool, measure: str = "iou") -> np.ndarray:
    """Which of the boxes, best first, stay. ``inclusive`` suppresses at the threshold itself."""
    keep = np.ones(len(boxes), bool)
    for i in range(len(boxes) - 1):
        if keep[i]:
            rest = np.flatnonzero(keep[i + 1 :]) + i + 1
            if not len(rest):
                break
            o = overlap_matrix(boxes[i], boxes[rest], measure)
            keep[rest[(o >= threshold) if inclusive else (o > threshold)]] = False
    return keep


def suppress_boxes(rows: DataFrame, groups: list[str], threshold: float, inclusive: bool = False, measure: str = "iou", chunk: int = CHUNK) -> DataFrame:
    """Groups and id of the boxes that stay; ``rows`` has the groups, id, score and bbox (xywh).

    Order is by score downwards, equal scores by id upwards. Defined cases: null and NaN scores come last,
    then by id; null or short boxes overlap nothing and stay; empty boxes overlap nothing; ids should be
    unique in a group, further rows of an id are items of their own; null groups are a group.
    """
    xywh = F.when(B.at(F.col("bbox"), 3).isNotNull(), F.slice(F.transform("bbox", lambda v: v.cast("double")), 1, 4)).otherwise(F.array(*[F.lit(0.0)] * 4))
    order = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    flat = rows.select(*groups, "id", order.alias("_s"), *(xywh[i].alias(f"_{c}") for i, c in enumerate("xywh")))
    todo = materialize(flat.withColumn("_n", F.monotonically_increasing_id()), "boxes")
    names = {f.name: f.dataType.simpleString() for f in todo.schema.fields}

    def decide(rows: pa.Table, bounds: list[int]) -> pa.Table:
        xywh = np.stack([rows.column(f"_{c}").to_numpy() for c in "xywh"], 1)
        return rows.filter(pa.array(np.concatenate([greedy(xywh[a:b], threshold, inclusive, measure) for a, b in zip(bounds, bounds[1:], strict=False)])))

    kept: DataFrame | None = None
    by_score = Window.partitionBy(*groups).orderBy(F.col("_s").desc(), "id", "_n")
    while True:  # a box alone in its group needs no decision
        top = todo.withColumn("_k", F.row_number().over(by_score)).where(F.col("_k") <= chunk)
        top = materialize(top.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy(*groups)) == 1), "best")
        schema = ", ".join(f"`{c}` {names[c]}" for c in todo.columns) + ", _k INT, _alone BOOLEAN"
        decided = map_groups(top.where("NOT _alone"), groups, decide, schema, ["_k"])
        best = materialize(top.where("_alone").unionByName(decided), "kept")
        kept = best if kept is None else kept.unionByName(best)
        cut = top.where(F.col("_k") == chunk).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.struct(-F.col("_s"), F.col("id"), F.col("_n")).alias("_cut"))
        cut = materialize(cut, "cut")  # one row for each group of more than a chunk
        if not cut.head(1):
            return kept.select(*groups, "id")
        same = None
        for i, g in enumerate(groups):
            e = F.col(g).eqNullSafe(F.col(f"_g{i}"))
            same = e if same is None else same & e
        left = todo.join(F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut, same & (F.struct(-F.col("_s"), F.col("id"), F.col("_n")) > F.col("_cut"))).select(*todo.columns)
        against = best.join(cut.select(*(F.col(f"_g{i}").alias(g) for i, g in enumerate(groups))), groups, "left_semi") if len(groups) else best
        names2 = {c: f"_o{c}" for c in ("_x", "_y", "_w", "_h")} | {g: f"_g{i}" for i, g in enumerate(groups)}
        against = against.select(*groups, "_x", "_y", "_w", "_h").withColumnsRenamed(names2)
        a, b = F.array("_x", "_y", "_w", "_h"), F.array("_o_x", "_o_y", "_o_w", "_o_h")
        o = B.iom_xywh(a, b) if measure == "iom" else B.iou_xywh(a, b)
        hit = (o >= threshold) if inclusive else (o > threshold)
        small = against.count() <= BROADCAST_ROWS
        todo = materialize(left.join(F.broadcast(against) if small else against, same & hit, "left_anti"), "boxes")


def suppress_pairs(items: DataFrame, pairs: DataFrame, groups: list[str], hit: Callable[[Column], Column]) -> DataFrame:
    """Greedy suppression by any similarity: ``items`` has groups, id and score, ``pairs`` the groups, id, other
    and similarity of overlapping items of a group (either order, each pair once). Groups and id that stay.

    Per group only the pairs that ``hit`` are collected, so a group must have a bounded number of them, as the
    masks of a frame or the tracks of a video do.
    """
    edges = pairs.where(hit(F.col("similarity"))).groupBy(*groups).agg(F.collect_list(F.struct("id", "other")).alias("edges"))
    order = F.struct((-F.coalesce(F.nanvl(F.col("score"), F.lit(float("-inf"))), F.lit(float("-inf")))).alias("s"), F.col("id").alias("id"))
    ranked = items.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["id"]).alias("ids"))

    def keep(ids: pa.Array, edges: pa.Array) -> pa.Array:
        out = []
        for own, es in zip(ids.to_pylist(), edges.to_pylist(), strict=True):
            near: dict[int, list[int]] = {}
            for e in es or []:
                near.setdefault(e["id"], []).append(e["other"])
                near.setdefault(e["other"], []).append(e["id"])
            gone: set[int] = set()
            stay = []
            for i in own:
                if i not in gone:
                    stay.append(i)
                    gone.update(near.get(i, ()))
            out.append(stay)
        return pa.array(out, pa.list_(pa.int64()))

    joined = ranked.join(edges, groups, "left")
    return joined.select(*groups, F.explode(F.arrow_udf(keep, "array<bigint>")("ids", "edges")).alias("id"))


def suppress_occluded(pairs: DataFrame, threshold: float = 0.7, reverse: bool = False) -> DataFrame:
    """Of two overlapping objects of a frame that both were occluded before, the one occluded more recently is
    suppressed (``reverse``: the one longer ago), all pairs at once.

    ``pairs``: frame, a, b (a < b), similarity, last_a, last_b (last occluded frame, null or -1: never). If one
    of them never was occluded, or both at the same frame, neither goes. With ``reverse`` one that never was
    occluded counts as longest ago, and goes. Result: frame, id.
    """
    last_a, last_b = F.coalesce("last_a", F.lit(-1)), F.coalesce("last_b", F.lit(-1))
    more = lambda x, y: (x < y) if reverse else (x > y)
    loser = F.when(more(last_a, last_b) & (last_b > -1), F.col("a")).when(more(last_b, last_a) & (last_a > -1), F.col("b"))
    return pairs.where(F.col("similarity") >= threshold).select("frame", loser.alias("id")).where(F.col("id").isNotNull()).distinct()
