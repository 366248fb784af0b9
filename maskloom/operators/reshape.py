"""Re-keying and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.functions import boxes as B
from maskloom.shared import materialize


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of unique keys, without one task seeing all rows: range partitions are
    counted, and each row adds its place in its partition to the rows before that partition."""
    part = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return part.join(F.broadcast(before.drop("_n")), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first") + start).drop("_p", "_i", "_before", "_first")


def unique_ids(df: DataFrame, group: str, key: str) -> DataFrame:
    """``new_<key>``: the key, or a new one beyond the largest where several groups use it."""
    used = df.select(group, key).distinct()
    many = used.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    top = df.agg(F.max(key).alias("m")).first()["m"] or 0
    fresh = number_rows(used.join(many, key, "left_semi"), [key, group], f"new_{key}", top + 1)
    return df.join(fresh, [group, key], "left").withColumn(f"new_{key}", F.coalesce(f"new_{key}", key))


def relabel(df: DataFrame, group: list[str], key: str, name: str, descending: bool = False) -> DataFrame:
    """Dense labels from 0 of a group's keys."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*group).orderBy(order)) - 1)


def one_based(df: DataFrame, key: str, refs: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Ids moved up by one where the table has id 0, with the references to it."""
    shift = 1 if df.where(F.col(key) == 0).head(1) else 0
    moved = df.withColumn(key, F.col(key) + shift)
    return moved, {name: t.withColumn(c, F.col(c) + shift) for name, (t, c) in refs.items()}


def explode_tracks(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks (parallel arrays bboxes, segmentations, areas) as one row per frame that has a box or mask:
    keys, frame, box, mask, area (w * h where none is given). Arrays may be null or of different lengths."""
    tracks = tracks.withColumns({c: F.coalesce(c, F.array()) for c in ("bboxes", "segmentations", "areas")})
    f = tracks.select(*keys, F.posexplode(F.arrays_zip("bboxes", "segmentations", "areas")).alias("frame", "z"))
    f = f.select(*keys, "frame", F.col("z.bboxes").alias("box"), F.col("z.segmentations").alias("mask"), F.col("z.areas").alias("area"))
    f = f.where(~B.is_zero(F.col("box")) | F.col("mask").isNotNull())
    return f.withColumn("area", F.coalesce("area", B.area_xywh(F.col("box"))))


def pack_tracks(frames: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """The inverse: bboxes, segmentations and areas by frame, null where a track has no row. ``frames`` has keys,
    frame, box, mask, area and a column of the track's number of frames."""
    cell = F.struct("frame", "box", "mask", "area")
    packed = frames.groupBy(*keys).agg(F.max(length).alias("_n"), F.map_from_entries(F.collect_list(F.struct("frame", cell))).alias("_by"))
    at = F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)))
    by_frame = lambda name: F.transform(at, lambda i: F.try_element_at("_by", i)[name])
    return packed.select(*keys, by_frame("box").alias("bboxes"), by_frame("mask").alias("segmentations"), by_frame("area").alias("areas"))


def pad(values: Column, longest: Column, filler: Column) -> Column:
    return F.concat(values, F.array_repeat(filler, longest.cast("int") - F.size(values)))
