"""Readers of dataset and result documents, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.functions import runs as R

SEGMENTATION = "STRUCT<counts: STRING, size: ARRAY<INT>>"
IMAGE = "id BIGINT, file_name STRING, text_input STRING, width INT, height INT, queried_category STRING, is_instance_exhaustive INT, is_pixel_exhaustive INT, rarity INT"
ANNOTATION = "id BIGINT, image_id BIGINT, source STRING, area DOUBLE, bbox ARRAY<DOUBLE>, segmentation STRING, category_id BIGINT, iscrowd INT"
CATEGORY = "id BIGINT, name STRING"
VIDEO = "id BIGINT, video_name STRING, file_names ARRAY<STRING>, height INT, width INT, length INT"
MASKLET = f"id BIGINT, segmentations ARRAY<{SEGMENTATION}>, bboxes ARRAY<ARRAY<DOUBLE>>, areas ARRAY<DOUBLE>, iscrowd INT, video_id STRING, height INT, width INT, category_id BIGINT, noun_phrase STRING, tags ARRAY<STRING>"
PAIR = "id BIGINT, video_id BIGINT, category_id BIGINT, noun_phrase STRING, num_masklets INT"
RESULT = "image_id BIGINT, category_id BIGINT, bbox ARRAY<DOUBLE>, score DOUBLE, segmentation STRING, area DOUBLE, keypoints ARRAY<DOUBLE>"
TRACK_RESULT = f"video_id BIGINT, category_id BIGINT, bboxes ARRAY<ARRAY<DOUBLE>>, score DOUBLE, segmentations ARRAY<{SEGMENTATION}>, areas ARRAY<DOUBLE>, per_frame_scores ARRAY<DOUBLE>"


def _struct(fields: str) -> str:
    """A column list as STRUCT: the first blank of each top-level field becomes a colon."""
    out, depth, part = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += c
    return f"STRUCT<{', '.join(out)}>"


def read_dataset(spark: SparkSession, path: str | list[str], video: bool = False) -> dict[str, DataFrame]:
    """One frame per record list of dataset documents (one JSON object a file), with ``_file``.

    A file is one task, as JSON objects can't be split; write the frames as Parquet once, and read that. A
    list that is absent is an empty frame; a file that is no JSON is an error.
    """
    lists = {"videos": VIDEO, "annotations": MASKLET, "categories": CATEGORY, "video_np_pairs": PAIR} if video else {"images": IMAGE, "annotations": ANNOTATION, "categories": CATEGORY}
    schema = ", ".join(f"{name} ARRAY<{_struct(fields)}>" for name, fields in lists.items())
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    docs = docs.select("*", F.col("_metadata.file_path").alias("_file"))
    out = {name: docs.select("_file", F.inline(F.coalesce(name, F.array()))) for name in lists}
    if video:
        a = out["annotations"].withColumn("video_id", F.expr("try_cast(trim(video_id) AS BIGINT)"))
        out["annotations"] = a.withColumn("bboxes", F.transform("bboxes", lambda b: F.coalesce(b, F.array(*[F.lit(0.0)] * 4)))).withColumn("mean_area", F.try_divide(F.aggregate("areas", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), F.size("areas").cast("double")))
    else:
        out["annotations"] = out["annotations"].withColumn("segmentation", mask_of_json(F.col("segmentation")))
        out["images"] = out["images"].withColumn("queried_category", F.expr("try_cast(queried_category AS BIGINT)"))
    return out


def mask_of_json(text: Column) -> Column:
    """A compressed mask of JSON text that is a mask with text or list counts; null for polygons, which need
    the image's size (``functions.runs.mask_of_polygons``)."""
    compressed = F.from_json(text, SEGMENTATION)
    listed = F.from_json(text, "STRUCT<counts: ARRAY<INT>, size: ARRAY<INT>>")
    as_list = listed["counts"].isNotNull()  # a compact text may begin with a bracket too
    return F.when(as_list, F.struct(R.counts_text(listed["counts"]).alias("counts"), listed["size"].alias("size"))).when(compressed["size"].isNotNull(), compressed)


def read_results(spark: SparkSession, path: str | list[str], images: DataFrame | None = None) -> DataFrame:
    """Result rows (a JSON array a file) with what the record kind lacks: a box from its mask or keypoints, the
    area from the box or mask, ``iscrowd`` 0. With ``images``, a row of an unknown image is an error when read."""
    raw = spark.read.schema(RESULT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    mask = mask_of_json(F.col("segmentation"))
    rows = raw.withColumn("segmentation", mask)
    box = F.coalesce("bbox", F.when(F.col("segmentation").isNotNull(), R.mask_box(F.col("segmentation"))), B.keypoint_box(F.col("keypoints")))
    rows = rows.withColumn("bbox", box).withColumn("area", F.coalesce("area", B.area_xywh(F.col("bbox")))).withColumn("iscrowd", F.lit(0))
    return rows if images is None else with_known(rows, "image_id", images)


def with_known(rows: DataFrame, ref: str, targets: DataFrame, key: str = "id") -> DataFrame:
    """The rows; reading one whose reference is unknown raises."""
    known = targets.select(F.col(key).alias(ref)).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, ref, "left")
    checked = F.when(F.col("_known"), F.col(ref)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {ref}: "), F.coalesce(F.col(ref).cast("string"), F.lit("null")))))
    return joined.withColumn(ref, checked).drop("_known").select(*rows.columns)


def read_track_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(TRACK_RESULT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def grouped_by_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each image with its annotations in order of id, also without any. Images have few annotations."""
    own = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in annotations.columns if c not in ("id", "image_id")]))).alias("annotations"))
    joined = images.join(own, images["id"] == own["image_id"], "left").drop("image_id")
    return joined.withColumn("annotations", F.coalesce("annotations", F.array()))


def image_queries(images: DataFrame) -> DataFrame:
    """One query an image row: its phrase."""
    return images.select(F.col("id").alias("image_id"), F.col("text_input").alias("query_text"), F.col("queried_category").cast("long").alias("category_id"), F.coalesce(F.col("is_instance_exhaustive") != 0, F.lit(False)).alias("is_exhaustive"))


def video_queries(pairs: DataFrame, videos: DataFrame, categories: DataFrame) -> DataFrame:
    """One query for each phrase of a video and frame; the category's name must be the phrase."""
    named = pairs.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    same = F.when(F.col("name") == F.col("noun_phrase"), F.col("noun_phrase")).otherwise(F.raise_error(F.concat(F.lit("phrase differs from its category: "), F.col("noun_phrase"))))
    v = videos.select(F.col("id").alias("video_id"), "file_names")
    return named.withColumn("query_text", same).join(v, "video_id").select("video_id", "category_id", "query_text", "num_masklets", F.posexplode("file_names").alias("frame", "file_name"))


def category_chunks(images: DataFrame, categories: DataFrame, size: int, most: int = 100_000) -> DataFrame:
    """Each image with each chunk of ``size`` categories, as array: queries with negatives. The categories are
    a dimension of at most ``most`` rows (more are refused) and come as a constant."""
    names = [(r["id"], r["name"]) for r in categories.where("id IS NOT NULL").select("id", "name").distinct().orderBy("id", "name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} categories")
    chunks = [names[i : i + size] for i in range(0, len(names), size)]
    rows = categories.sparkSession.createDataFrame([(k, c) for k, c in enumerate(chunks)], "chunk INT, categories ARRAY<STRUCT<id: BIGINT, name: STRING>>")
    numbers = images.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))) if chunks else images.withColumn("chunk", F.lit(None).cast("int"))
    return numbers.join(F.broadcast(rows), "chunk")
