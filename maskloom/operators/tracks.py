"""Similarity of whole tracks, and suppression and resolution of masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.functions import boxes as B
from maskloom.functions import runs as R
from maskloom.functions.kernel import kernel
from maskloom.operators.overlaps import overlap_sums


def track_pairs(truth: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of tracks with IoU > 0: keys, gt, det, iou. Both: keys, t, id, box.

    Intersections over common frames, by the union over all frames of either: a frame that only one of the
    tracks has counts with its area. (Suppression of tracks counts common frames only, see the queries.)
    """
    area = F.sum(F.greatest(F.coalesce(B.area_xywh(F.col("box")), F.lit(0.0)), F.lit(0.0)))
    sizes = lambda df, name: df.groupBy(*keys, F.col("id").alias(name)).agg(area.alias(f"{name}_area"))
    g = truth.select(*keys, "t", F.col("id").alias("gt"), F.col("box").alias("gb"))
    d = detected.select(*keys, "t", F.col("id").alias("det"), F.col("box").alias("db"))
    met = overlap_sums(g, d, [*keys, "t"], "gb", "db").groupBy(*keys, "gt", "det").agg(F.sum("inter").alias("inter"))
    j = met.join(sizes(truth, "gt"), [*keys, "gt"]).join(sizes(detected, "det"), [*keys, "det"])
    return j.select(*keys, "gt", "det", (F.col("inter") / (F.col("gt_area") + F.col("det_area") - F.col("inter"))).alias("iou"))


def mask_pairs(items: DataFrame, keys: list[str], measure: str = "iou") -> DataFrame:
    """keys, id, other, similarity > 0 of the masks of a frame whose boxes overlap, each pair once. ``items``: keys,
    id, mask. Masks are decoded for their boxes first, and only pairs of overlapping boxes are compared."""
    boxed = items.select(*keys, "id", "mask", R.mask_box(F.col("mask")).alias("box"))
    met = overlap_sums(boxed, boxed.withColumnsRenamed({"id": "other", "mask": "mask2", "box": "box2"}), keys, "box", "box2", F.col("id") < F.col("other"))
    similarity = (R.mask_iom if measure == "iom" else R.mask_iou)(F.col("mask"), F.col("mask2"))
    return met.select(*keys, "id", "other", similarity.alias("similarity")).where("similarity > 0")


def best_of_several(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of greatest IoU per key; where every IoU of the whole batch is 0, of greatest score. Equal:
    the smallest id. ``candidates``: batch, keys, id, iou, score."""
    any_iou = F.max("iou").over(Window.partitionBy("batch")) > 0
    value = F.when(any_iou, F.col("iou")).otherwise(F.col("score"))
    ranked = candidates.withColumn("_v", value).withColumn("_k", F.row_number().over(Window.partitionBy("batch", *keys).orderBy(F.col("_v").desc(), "id")))
    return ranked.where("_k = 1").drop("_v", "_k")


def mean_mask_iou(pairs: DataFrame) -> DataFrame:
    """Mean IoU over targets that aren't empty, 1 if there are none. ``pairs``: iou, target_area."""
    hit = F.col("target_area") > 0
    return pairs.agg(F.coalesce(F.avg(F.when(hit, F.col("iou"))), F.lit(1.0)).alias("miou"))


def frame_of_track(tracks: DataFrame, frame: int) -> DataFrame:
    """Mask and box of every track in one frame; tracks without any there are left out."""
    at = F.lit(frame)
    f = tracks.select("id", "video_id", F.get("segmentations", at).alias("mask"), F.get("bboxes", at).alias("box"))
    return f.where(F.col("mask").isNotNull() | F.col("box").isNotNull())


def resolved(frames: DataFrame, keys: list[str], shrunk: float = 0.3) -> DataFrame:
    """Masks of a frame without overlaps: each pixel stays with the best score (equal: smallest id). A mask left
    with less than ``shrunk`` of its area is emptied. ``frames``: keys, id, score, mask; a frame's masks have
    one size, others are left as they are."""
    order = F.struct((-F.coalesce(F.nanvl("score", F.lit(float("-inf"))), F.lit(float("-inf")))).alias("s"), "id", "mask")
    lists = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("m"))  # the objects of a frame

    def run(groups: pa.Array) -> pa.Array:
        out = []
        for own in groups.to_pylist():
            taken, rows = {}, []
            for r in own:
                m = r["mask"]
                if m is None or not R.Runs.parse([m["counts"]], [m["size"]]).valid[0]:
                    rows.append({"id": r["id"], "mask": m})
                    continue
                p, size = R.pixels(m["counts"], m["size"]), tuple(m["size"])
                free = p & ~taken[size] if size in taken else p
                taken[size] = taken[size] | p if size in taken else p
                left = free if free.sum() >= shrunk * p.sum() else np.zeros_like(p)
                text, hw = R.from_pixels(left)
                rows.append({"id": r["id"], "mask": {"counts": text, "size": hw}})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("mask", pa.struct([("counts", pa.string()), ("size", pa.list_(pa.int32()))]))])))

    solved = F.arrow_udf(run, f"array<struct<id: bigint, mask: {R.MASK}>>")("m")
    return lists.select(*keys, F.inline(solved))


def _polygon(b: list[float]) -> np.ndarray:
    t = np.radians(b[4])
    c, s = np.cos(t), np.sin(t)
    corners = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * [b[2] / 2, b[3] / 2]
    return corners @ np.array([[c, -s], [s, c]]) + [b[0], b[1]]


def _clip(subject: np.ndarray, clip: np.ndarray) -> float:
    """Area of a convex polygon within another, cutting it along each edge."""
    for k in range(len(clip)):
        a, e = clip[k], clip[(k + 1) % len(clip)] - clip[k]
        side = e[0] * (subject[:, 1] - a[1]) - e[1] * (subject[:, 0] - a[0])
        kept = []
        for i in range(len(subject)):
            j = (i + 1) % len(subject)
            if side[i] >= 0:
                kept.append(subject[i])
            if side[i] * side[j] < 0:
                kept.append(subject[i] + (subject[j] - subject[i]) * side[i] / (side[i] - side[j]))
        if len(kept) < 3:
            return 0.0
        subject = np.array(kept)
    x, y = subject[:, 0], subject[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


@kernel("double")
def rotated_iou(a: pa.Array, b: pa.Array) -> pa.Array:
    """IoU of two xywha boxes; 0 for empty ones, null for null or short ones."""
    out = []
    for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if p is None or q is None or len(p) < 5 or len(q) < 5 or None in p or None in q:
            out.append(None)
            continue
        areas = max(p[2] * p[3], 0.0), max(q[2] * q[3], 0.0)
        common = _clip(_polygon(p), _polygon(q)) if min(areas) > 0 else 0.0
        union = sum(areas) - common
        out.append(common / union if union > 0 else 0.0)
    return pa.array(out, pa.float64())


def unmatched_out(detections: DataFrame, matched: DataFrame, exhaustive: DataFrame) -> DataFrame:
    """Detections without those that match nothing where that can't be judged: of a (seq, cls) that is neither
    known to be absent nor annotated exhaustively. ``matched``: seq, t, id; ``exhaustive``: seq, cls."""
    judged = detections.join(matched.select("seq", "t", "id").distinct().withColumn("_hit", F.lit(True)), ["seq", "t", "id"], "left")
    judged = judged.join(exhaustive.select("seq", "cls").distinct().withColumn("_all", F.lit(True)), ["seq", "cls"], "left")
    return judged.where(F.col("_hit") | F.col("_all")).drop("_hit", "_all")


