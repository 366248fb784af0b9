"""Sampling and geometry of annotated samples. Choices are by hash of (seed, key): the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import boxes as B


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def cap_queries(df: DataFrame, most: int, seed: int, positives_first: bool = False) -> DataFrame:
    """At most ``most`` queries of each datapoint, chosen at random, in their old order."""
    q = F.coalesce("find_queries", F.array())
    negative = lambda x: F.when(F.size(F.coalesce(x["object_ids_output"], F.array().cast("array<int>"))) > 0, 0).otherwise(1) if positives_first else F.lit(0)
    tagged = F.transform(q, lambda x, i: F.struct(negative(x).alias("n"), F.xxhash64(F.lit(seed), F.col("datapoint_id"), i).alias("r"), i.alias("i"), x.alias("q")))
    less = lambda a, b: F.when(a["n"] != b["n"], a["n"] - b["n"]).when(a["r"] < b["r"], -1).when(a["r"] > b["r"], 1).otherwise(0)
    chosen = F.slice(F.array_sort(tagged, less), 1, most)
    back = F.array_sort(chosen, lambda a, b: a["i"].cast("int") - b["i"].cast("int"))
    return df.withColumn("find_queries", F.transform(back, lambda t: t["q"]))


def same_queries_per_frame(df: DataFrame, most: int, seed: int) -> DataFrame:
    """The choice made among the queries of image 0, by their ordinal, applied to every image."""
    q = F.coalesce("find_queries", F.array())
    images = F.array_sort(F.array_distinct(F.transform(q, lambda x: x["image_id"])))
    first = F.size(F.filter(q, lambda x: x["image_id"] == F.get(images, F.lit(0))))
    tickets = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("datapoint_id"), i).alias("r"), i.alias("i"))))
    kept = F.transform(F.slice(tickets, 1, most), lambda t: t["i"])
    per_image = F.transform(images, lambda im: F.filter(F.filter(q, lambda x: x["image_id"].eqNullSafe(im)), lambda x, i: F.array_contains(kept, i)))
    return df.withColumn("find_queries", F.flatten(per_image))


def sampled_stages(stages: Column, most: int, stride: int) -> Column:
    """Every ``stride``-th stage, with the largest stride down to 1 that gives ``most`` of them, then cut."""
    n = F.size(stages)
    step = F.greatest(F.lit(1), F.least(F.lit(stride), F.floor(F.try_divide(n - 1, F.lit(max(most - 1, 1)))).cast("int")))
    return F.slice(F.filter(stages, lambda s, i: i % step == 0), 1, most)


def tiled(df: DataFrame, frames: int) -> DataFrame:
    """Each row for every frame: ``frame`` from 0 on."""
    return df.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))


def chance(text: Column, key: Column, seed: int, p: float, instead: str) -> Column:
    """``text``, replaced with probability p."""
    return F.when(draw(seed, key) < p, F.lit(instead)).otherwise(text)


def text_or_target(df: DataFrame, seed: int, p: float) -> DataFrame:
    """With probability p a query loses its text and gets the box of one of its targets as input."""
    def swap(q: Column, k: Column) -> Column:
        ids = F.coalesce(q["object_ids_output"], F.array().cast("array<int>"))
        pick = F.get(ids, F.pmod(F.xxhash64(F.lit(seed + 1), F.col("datapoint_id"), k), F.greatest(F.size(ids), F.lit(1)).cast("long")).cast("int"))
        box = F.get(F.get(F.col("images"), q["image_id"])["objects"], pick)["bbox"]
        do = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("datapoint_id"), k), 11) / float(1 << 53) < p) & box.isNotNull()
        return F.when(do, q.withField("query_text", F.lit("visual")).withField("input_bbox", F.array(box))).otherwise(q)

    return df.withColumn("find_queries", F.transform("find_queries", swap))


def cropped(box: Column, points: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Box (null if nothing of it is left) and points within a crop; points on the far edge still are in it."""
    b = B.crop_xyxy(box, x, y, w, h)
    inside = F.filter(points, lambda p: (p[0] >= x) & (p[0] <= x + w) & (p[1] >= y) & (p[1] <= y + h))
    moved = F.transform(inside, lambda p: F.concat(F.array(p[0] - x, p[1] - y), F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0)))))
    return F.when((B.at(b, 2) > B.at(b, 0)) & (B.at(b, 3) > B.at(b, 1)), b), moved


def resized(box: Column, sx: Column, sy: Column) -> Column:
    return B.scale_xyxy(box, sx, sy)


def noisy(box: Column, key: Column, seed: int, amount: float, width: Column, height: Column) -> Column:
    """Corners of an xyxy box moved by up to ``amount`` of its sides, kept in the image."""
    u = lambda i: (draw(seed + i, key) * 2 - 1) * amount
    w, h = B.at(box, 2) - B.at(box, 0), B.at(box, 3) - B.at(box, 1)
    moved = B.make(B.at(box, 0) + u(0) * w, B.at(box, 1) + u(1) * h, B.at(box, 2) + u(2) * w, B.at(box, 3) + u(3) * h)
    return B.clip_xyxy(moved, width, height)


def point_in_box(box: Column, key: Column, seed: int) -> Column:
    """A random point of an xyxy box, labelled 1."""
    return B.make(B.at(box, 0) + draw(seed, key) * (B.at(box, 2) - B.at(box, 0)), B.at(box, 1) + draw(seed + 1, key) * (B.at(box, 3) - B.at(box, 1)), F.lit(1.0))


def limited_ids(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows at random: the smallest hashes; sorted by partial limits, not in one task."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def with_quarantine(raw: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rows that could not be parsed): nothing is replaced by another row."""
    parsed = raw.withColumn("_v", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col(text).isNull() | F.col("_v").isNull() | F.col("_v._bad").isNotNull()
    return parsed.where(~broken).select(*raw.columns, "_v.*").drop("_bad"), parsed.where(broken).select(*raw.columns)
