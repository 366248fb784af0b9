"""Filters over detections, tracks, queries and datasets.

Predicates return columns, to be used in ``where``, so that they are pushed into the scan; filters against
other tables are semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import boxes as B

#: Ranges of relative areas, and of areas in pixels for tracks; names, lower and upper ends.
RELATIVE_AREAS = [("all", 0.0, 1e5), ("tiny", 0.0, 0.001), ("small", 0.001, 0.01), ("medium", 0.01, 0.1), ("large", 0.1, 0.5), ("huge", 0.5, 0.95), ("whole_image", 0.95, 1e5)]
PIXEL_AREAS = [("all", 0.0, 1e10), ("small", 0.0, 128.0**2), ("medium", 128.0**2, 256.0**2), ("large", 256.0**2, 1e10)]


def over(score: Column, threshold: float, rule: str = ">=", only_positive: bool = False) -> Column:
    """``rule`` is ``>=`` or ``>``; with ``only_positive`` a threshold of 0 or less keeps all. Null and NaN fail."""
    if only_positive and threshold <= 0:
        return F.lit(True)
    hit = score >= threshold if rule == ">=" else score > threshold
    return F.coalesce(hit & ~F.isnan(score), F.lit(False))


def in_buckets(df: DataFrame, area: Column, buckets: list[tuple[str, float, float]] = RELATIVE_AREAS) -> DataFrame:
    """A row per range the area is in (both ends belong to it), with ``bucket``: a range join with a few rows,
    done row by row instead of as a join."""
    hits = F.filter(F.array(*(F.when((area >= low) & (area <= high), F.lit(name)) for name, low, high in buckets)), lambda b: b.isNotNull())
    return df.select("*", F.explode(hits).alias("bucket"))


def evaluable_images(images: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Images annotated exhaustively, and not marked otherwise by any of the other annotators."""
    own = images.where(F.coalesce(F.col("is_instance_exhaustive"), F.lit(0)) != 0)
    for other in others:
        own = own.join(other.where(F.coalesce(F.col("is_instance_exhaustive"), F.lit(0)) == 0).select("id"), "id", "left_anti")
    return own


def positive_split(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections whose category occurs in their image's ground truth."""
    return detections.join(truth.select("image_id", "category_id").distinct(), ["image_id", "category_id"], "left_semi")


def availability(keys: DataFrame, available: DataFrame, key: str, dependents: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Rows of ``keys`` that are available, and of each dependent table those that refer to them."""
    left = keys.join(available.select(key).distinct(), key, "left_semi")
    return {"keys": left} | {name: df.join(left.select(F.col(key).alias(ref)).distinct(), ref, "left_semi") for name, (df, ref) in dependents.items()}


def unknown_references(df: DataFrame, ref: str, targets: DataFrame, key: str = "id") -> DataFrame:
    """Rows that refer to nothing: what a loader has to refuse."""
    return df.where(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def repeated_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_ignored(df: DataFrame, ignored: Column) -> tuple[DataFrame, DataFrame]:
    """(data, ignore regions): each row is in one of them; null is data."""
    c = F.coalesce(ignored, F.lit(False))
    return df.where(~c), df.where(c)


# Queries of a datapoint: arrays of structs, filtered in place with positions renumbered


def keep_queries(df: DataFrame, keep) -> DataFrame:
    """Queries for which ``keep(query, images)`` is true, stages renumbered densely; a datapoint stays, also
    without queries, so that callers decide what to do with it. Null lists are empty."""
    queries = F.filter(F.coalesce("find_queries", F.array()), lambda q: F.coalesce(keep(q, F.col("images")), F.lit(False)))
    order = F.array_sort(F.array_distinct(F.transform(queries, lambda q: q["query_processing_order"])))
    return df.withColumn("find_queries", F.transform(queries, lambda q: q.withField("query_processing_order", (F.array_position(order, q["query_processing_order"]) - 1).cast("int"))))


def outputs(q: Column, images: Column) -> Column:
    """The objects a query names by position in its image."""
    objects = F.get(images, q["image_id"])["objects"]
    return F.transform(F.coalesce(q["object_ids_output"], F.array().cast("array<int>")), lambda i: F.get(objects, i))


def text_not_in(*texts: str):
    return lambda q, images: F.coalesce(~q["query_text"].isin(*texts), F.lit(True))


def semantic_only(q: Column, images: Column) -> Column:
    return q["input_bbox"].isNull() & q["input_points"].isNull()


def no_zero_boxes(q: Column, images: Column) -> Column:
    area = lambda o: F.coalesce((F.get(o["bbox"], F.lit(2)) - F.get(o["bbox"], F.lit(0))) * (F.get(o["bbox"], F.lit(3)) - F.get(o["bbox"], F.lit(1))), F.lit(0.0))
    return ~F.exists(outputs(q, images), lambda o: area(o) <= 0)


def at_most_outputs(n: int):
    return lambda q, images: F.size(F.coalesce(q["object_ids_output"], F.array().cast("array<int>"))) <= n


def exhaustive_only(kind: str = "instance"):
    """``pixel``: unknown counts as exhaustive; ``instance``: it does not; ``both`` needs both."""
    instance = lambda q: F.coalesce(q["is_exhaustive"], F.lit(False))
    pixel = lambda q: F.coalesce(q["is_pixel_exhaustive"], F.lit(True))
    return lambda q, images: instance(q) if kind == "instance" else pixel(q) if kind == "pixel" else instance(q) & pixel(q)


def valid_geometric(q: Column, images: Column) -> Column:
    """Geometric queries need outputs."""
    geometric = q["input_bbox"].isNotNull() | q["input_points"].isNotNull()
    return ~geometric | (F.size(F.coalesce(q["object_ids_output"], F.array().cast("array<int>"))) > 0)


def drop_objects(df: DataFrame, keep) -> DataFrame:
    """Objects for which ``keep(object)`` is true; positions in queries are moved to the objects' new places,
    those of dropped objects go."""
    ok = lambda o: F.coalesce(keep(o), F.lit(False))
    flags = F.transform("images", lambda im: F.transform(F.coalesce(im["objects"], F.array()), ok))

    def moved(q: Column) -> Column:
        own = F.get(F.col("_flags"), q["image_id"])
        alive = F.filter(q["object_ids_output"], lambda i: F.coalesce(F.get(own, i), F.lit(False)))
        place = lambda i: F.size(F.filter(F.slice(own, F.lit(1), i), lambda f: f))
        return q.withField("object_ids_output", F.transform(alive, place))

    images = F.transform("images", lambda im: im.withField("objects", F.filter(im["objects"], ok)))
    return df.withColumn("_flags", flags).withColumn("find_queries", F.transform("find_queries", moved)).withColumn("images", images).drop("_flags")


def drop_orphan_objects(df: DataFrame) -> DataFrame:
    """Objects no query names go; positions are moved."""
    named = F.flatten(F.transform(F.coalesce("find_queries", F.array()), lambda q: F.transform(F.coalesce(q["object_ids_output"], F.array().cast("array<int>")), lambda i: F.struct(q["image_id"].alias("image"), i.alias("object")))))
    marked = F.transform("images", lambda im, k: im.withField("objects", F.transform(im["objects"], lambda o, j: o.withField("_used", F.array_contains(F.col("_named"), F.struct(k.cast("int").alias("image"), j.cast("int").alias("object")))))))
    out = drop_objects(df.withColumn("_named", named).withColumn("images", marked), lambda o: o["_used"])
    clean = F.transform("images", lambda im: im.withField("objects", F.transform(im["objects"], lambda o: o.dropFields("_used"))))
    return out.withColumn("images", clean).drop("_named")


# Tracks: parallel arrays per frame


def absent_frames_null(boxes: Column, areas: Column) -> Column:
    """Boxes with null where the frame's area is null or 0, or its box zero."""
    return F.zip_with(boxes, areas, lambda b, a: F.when((F.coalesce(a, F.lit(0.0)) > 0) & ~B.is_zero(b), b))


def long_enough(counts: Column, least: int = 4) -> Column:
    """Encoded masks of more than ``least`` characters."""
    return F.coalesce(F.length(counts) > least, F.lit(False))


def same_size(width: Column, height: Column, mask_size: Column) -> Column:
    return (F.get(mask_size, F.lit(0)) == height) & (F.get(mask_size, F.lit(1)) == width)
