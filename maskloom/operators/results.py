"""Reshaping of results: rows from packed predictions, numbered frame tables, stages and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.functions import boxes as B
from maskloom.operators.reshape import explode_tracks, number_rows


def result_rows(predictions: DataFrame) -> DataFrame:
    """One row a detection from image_id and the parallel arrays boxes (xyxy), scores, labels[, masks]: image_id,
    category_id, bbox (xywh), score[, segmentation]. Arrays of different lengths are filled with null."""
    masks = "masks" in predictions.columns
    z = F.arrays_zip("boxes", "scores", "labels", *(["masks"] if masks else []))
    rows = predictions.select("image_id", F.explode(z).alias("z"))
    own = [F.col("z.labels").cast("long").alias("category_id"), B.xyxy_to_xywh(F.col("z.boxes")).alias("bbox"), F.col("z.scores").alias("score")]
    return rows.select("image_id", *own, *([F.col("z.masks").alias("segmentation")] if masks else []))


def frame_images(videos: DataFrame) -> DataFrame:
    """Frames of videos, numbered by (video, frame) from 1 on."""
    f = videos.select(F.col("id").alias("video_id"), "height", "width", F.posexplode("file_names").alias("frame_index", "file_name"))
    return number_rows(f, ["video_id", "frame_index"], "id", 1)


def track_rows(tracks: DataFrame) -> DataFrame:
    return explode_tracks(tracks, ["id", "video_id", "category_id", "iscrowd"]).withColumnsRenamed({"id": "track_id", "frame": "frame_index", "box": "bbox", "mask": "segmentation"})


def frame_tables(videos: DataFrame, tracks: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """images and annotations of videos and tracks, as documents of single frames have them: images are numbered
    by (video, frame), annotations by (video, frame, track), both from 1 on. A track's frame that its video doesn't
    have is an error when read; if not ``strict``, it has no annotation but is among ``dangling_frames``."""
    images = frame_images(videos)
    keyed = track_rows(tracks).join(images.select("video_id", "frame_index", F.col("id").alias("image_id")), ["video_id", "frame_index"], "left" if strict else "inner")
    if strict:
        known = F.when(F.col("image_id").isNotNull(), F.col("image_id")).otherwise(F.raise_error(F.concat(F.lit("no frame "), F.col("frame_index").cast("string"), F.lit(" in video "), F.coalesce(F.col("video_id").cast("string"), F.lit("null")))))
        keyed = keyed.withColumn("image_id", known)
    annotations = number_rows(keyed, ["video_id", "frame_index", "track_id"], "id", 1)
    return {"images": images, "annotations": annotations}


def dangling_frames(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks' frames without an image, with the ``reason``: the reference is null, its video is missing, or the
    video has no such frame."""
    v = videos.select(F.col("id").alias("video_id"), F.lit(True).alias("_video"), F.coalesce(F.size("file_names"), F.lit(0)).alias("_n"))
    r = track_rows(tracks).join(v, "video_id", "left")
    reason = F.when(F.col("video_id").isNull(), "null").when(F.col("_video").isNull(), "video").when(F.col("frame_index") >= F.col("_n"), "frame")
    return r.withColumn("reason", reason).where("reason IS NOT NULL").drop("_video", "_n")


def stages_together(parts: list[DataFrame]) -> DataFrame:
    """Outputs of several stages as one table, with ``stage`` from 0 on."""
    out = None
    for k, part in enumerate(parts):
        own = part.withColumn("stage", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def best_mask(rows: DataFrame) -> DataFrame:
    """One mask for each (media, object, frame): of the best score, equal: the smallest mask_no."""
    w = Window.partitionBy("media", "object", "frame").orderBy(F.col("score").desc_nulls_last(), "mask_no")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_versions(cached: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Cached rows with the updates put in their place, by the greatest ``version``."""
    w = Window.partitionBy(*keys).orderBy(F.col("version").desc())
    return cached.unionByName(updates).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reconditioned(frames: DataFrame, every: int, iou: float = 0.8, score: float = 0.8) -> DataFrame:
    """Tracks' masks replaced by their detections' on every n-th frame and where a strong detection hardly meets
    the track. ``frames``: frame, mask, det_mask, det_iou, det_score."""
    due = (F.col("frame") % every == 0) if every > 0 else F.lit(False)
    strong = F.coalesce(F.col("det_score") >= score, F.lit(False))
    swap = F.col("det_mask").isNotNull() & strong & (due | F.coalesce(F.col("det_iou") < iou, F.lit(False)))
    return frames.withColumn("mask", F.when(swap, F.col("det_mask")).otherwise(F.col("mask"))).withColumn("reconditioned", swap)


def by_score(scores: Column, *lists: Column) -> list[Column]:
    """Parallel lists in order of score downwards (equal: as they were), the scores first."""
    places = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    order = F.transform(F.array_sort(places), lambda p: p["i"])
    return [_picked(v, order) for v in (scores, *lists)]


def _picked(values: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(values, i))


def repeated_targets(pairs: DataFrame, repeats: int) -> DataFrame:
    """Pairs with every target (``right``) ``repeats`` times, so that an assignment gives it as many partners;
    ``right`` becomes right * repeats + copy."""
    copies = pairs.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return copies.withColumn("right", F.col("right") * repeats + F.col("_c")).drop("_c")
