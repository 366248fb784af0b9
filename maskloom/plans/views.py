"""The domain tables without copies, and what many queries share; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.operators.grouped import first_copy
from maskloom.operators.overlaps import overlapping
from maskloom.shared import table


def once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of the first delivery of each id."""
    return first_copy(table(spark, sf_dir, name).select("id", *columns, "delivered_at")).drop("delivered_at")


def once_sql(name: str, *columns: str) -> str:
    return f"(SELECT {', '.join(('id', *columns))} FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivered_at) = 1)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth with boxes in pixels: image_id, gt, box (xywh), crowd, category_id. Rows without a whole box
    have none to compare and are left out here; counts of annotations come from the table itself."""
    a = once(spark, sf_dir, "annotation", "image_id", "bbox", "iscrowd", "category_id")
    i = once(spark, sf_dir, "image", "width", "height").withColumnRenamed("id", "image_id")
    joined = a.join(i, "image_id")
    return joined.select("image_id", F.col("id").alias("gt"), B.to_absolute(F.col("bbox"), F.col("width"), F.col("height")).alias("gt_box"), (F.coalesce("iscrowd", F.lit(0)) == 1).alias("crowd"), F.col("category_id").alias("gt_category"))


TRUTH_SQL = f"""(SELECT a.image_id, a.id AS gt, CASE WHEN bbox[1] * bbox[2] * bbox[3] * bbox[4] * width * height IS NOT NULL THEN [bbox[1] * width, bbox[2] * height, bbox[3] * width, bbox[4] * height] END AS gt_box,
  coalesce(iscrowd, 0) = 1 AS crowd, a.category_id AS gt_category
  FROM {once_sql("annotation", "image_id", "bbox", "iscrowd", "category_id")} a JOIN {once_sql("image", "width", "height")} i ON a.image_id = i.id)"""


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: image_id, det, box (xywh pixels), score (null for NaN), category_id."""
    p = once(spark, sf_dir, "prediction", "image_id", "bbox", "score", "category_id")
    return p.select("image_id", F.col("id").alias("det"), F.col("bbox").alias("dt_box"), F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.col("category_id").alias("dt_category"))


DETECTED_SQL = f"""(SELECT image_id, id AS det, bbox AS dt_box, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, category_id AS dt_category
  FROM {once_sql("prediction", "image_id", "bbox", "score", "category_id")})"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and predictions of the same image that overlap, with their IoU."""
    return overlapping(truth(spark, sf_dir), detected(spark, sf_dir), ["image_id"], "gt_box", "dt_box")


def overlap_sql(a: str, b: str) -> str:
    x = f"greatest(least({a}[1] + {a}[3], {b}[1] + {b}[3]) - greatest({a}[1], {b}[1]), 0.0)"
    y = f"greatest(least({a}[2] + {a}[4], {b}[2] + {b}[4]) - greatest({a}[2], {b}[2]), 0.0)"
    return f"(CASE WHEN {a}[4] IS NOT NULL AND {b}[4] IS NOT NULL THEN {x} * {y} END)"


def iou_sql(a: str, b: str) -> str:
    u = f"({a}[3] * {a}[4] + {b}[3] * {b}[4] - {overlap_sql(a, b)})"
    return f"CASE WHEN {u} > 0 THEN {overlap_sql(a, b)} / {u} WHEN {u} IS NOT NULL THEN 0.0 END"


PAIRS_SQL = f"(SELECT * FROM (SELECT t.*, d.* EXCLUDE (image_id), {iou_sql('dt_box', 'gt_box')} AS iou FROM {TRUTH_SQL} t JOIN {DETECTED_SQL} d ON t.image_id = d.image_id) WHERE iou > 0)"
