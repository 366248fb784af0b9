"""Queries that write tables with the writers and read them back with the readers; their SQL reads the tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.plans import hota
from maskloom.plans import metric_sql as SQ
from maskloom.plans.evaluating import _TRACKS, FRAME_WEIGHTS, track_sets
from maskloom.plans.views import once, once_sql
from maskloom.shared import scratch, table
from maskloom.sources import datasets, files

QUERIES, SQL = {}, {}
DOCUMENT_ROWS = 2_000  #: rows of a document, about


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _documents(spark: SparkSession, rows: DataFrame, key: str, name: str, list_name: str) -> str:
    """Rows as documents of one JSON object a file with the list ``list_name``, rows of a key together; the folder."""
    path = scratch(spark, name)
    n = max(1, math.ceil(rows.count() / DOCUMENT_ROWS))
    part: Column = F.pmod(F.xxhash64(key), F.lit(n))
    docs = rows.groupBy(part.alias("_part")).agg(F.collect_list(F.struct(*rows.columns)).alias(list_name))
    docs.select(F.to_json(F.struct(list_name)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(f"SELECT id, image_id, source, area, bbox, segmentation.counts AS counts, category_id, iscrowd FROM {once_sql('annotation', 'image_id', 'source', 'area', 'bbox', 'segmentation', 'category_id', 'iscrowd')}")
def image_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations through dataset documents of images."""
    a = once(spark, sf_dir, "annotation", "image_id", "source", "area", "bbox", "segmentation", "category_id", "iscrowd")
    back = datasets.read_dataset(spark, _documents(spark, a, "image_id", "documents", "annotations"))["annotations"]
    return back.select("id", "image_id", "source", "area", "bbox", F.col("segmentation.counts").alias("counts"), "category_id", "iscrowd")


@query(f"""SELECT id, video_id, category_id, noun_phrase, list_transform(bboxes, lambda b: coalesce(b, [0.0, 0.0, 0.0, 0.0])) AS bboxes, round(list_sum(list_transform(areas, lambda a: coalesce(a, 0))) / nullif(len(areas), 0), 4) AS mean_area
  FROM {once_sql('masklet', 'video_id', 'category_id', 'noun_phrase', 'bboxes', 'areas')}""")
def video_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masklets through dataset documents of videos: absent boxes are zeros, with the mean area."""
    m = once(spark, sf_dir, "masklet", "video_id", "category_id", "noun_phrase", "bboxes", "areas")
    back = datasets.read_dataset(spark, _documents(spark, m, "video_id", "documents", "annotations"), video=True)["annotations"]
    return back.select("id", "video_id", "category_id", "noun_phrase", "bboxes", F.round("mean_area", 4).alias("mean_area"))


@query(f"SELECT image_id, category_id, round_even(score, 5) AS score, count(*) AS n FROM (SELECT image_id, category_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM {once_sql('prediction', 'image_id', 'category_id', 'score')}) GROUP BY ALL")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions through result files: scores as written, rounded to five digits."""
    path = scratch(spark, "results")
    p = once(spark, sf_dir, "prediction", "image_id", "category_id", "bbox", "score", "area")
    files.write_results(p.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))).drop("id"), path)
    rows = spark.read.schema(datasets.RESULT).json(path)
    return rows.groupBy("image_id", "category_id", "score").agg(F.count(F.lit(1)).alias("n"))


_MOT = f"""(SELECT CAST(t AS BIGINT) AS t, id, round(b[1], 2) AS x, CASE id % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'van' WHEN 2 THEN 'crowd' ELSE 'tree' END AS kind FROM
  (SELECT id, unnest(range(len(bboxes))) AS t, unnest(bboxes) AS b FROM {once_sql('masklet', 'bboxes')} WHERE id IS NOT NULL) WHERE len(b) >= 4 AND len(list_filter(b, lambda v: v > 0)) > 0)"""


@query(f"SELECT kind, 'data' AS part, count(*) AS n, round(sum(x), 1) AS x FROM {_MOT} WHERE kind IN ('car', 'van') GROUP BY kind UNION ALL SELECT kind, 'ignored', count(*), round(sum(x), 1) FROM {_MOT} WHERE kind = 'crowd' GROUP BY kind")
def tracking_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of tracks through delimited text, rows told apart by lists whatever the case of their letters."""
    path = scratch(spark, "mot")
    m = once(spark, sf_dir, "masklet", "bboxes").where("id IS NOT NULL")
    f = m.select("id", F.posexplode("bboxes").alias("t", "b")).where(~B.is_zero(F.col("b")))
    kind = F.element_at(F.array(*map(F.lit, ("Car", "VAN", "Crowd", "tree"))), (F.col("id") % 4 + 1).cast("int"))
    f.select("t", "id", F.round(B.at(F.col("b"), 0), 2).alias("x"), kind.alias("kind")).write.csv(path, sep=" ")
    data, ignored = files.mot_rows(files.read_mot(spark, path, ["t", "id", "x", "kind"]), valid={"kind": ["car", "van"]}, ignored={"kind": ["crowd"]})
    tell = lambda df, part: df.groupBy(F.lower("kind").alias("kind")).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 1).alias("x"))
    return tell(data, "data").unionByName(tell(ignored, "ignored"))


@query(f"""WITH RECURSIVE {_TRACKS}, {SQ.matched(FRAME_WEIGHTS, ["seq", "t"], "x0")}, {SQ.hota(True).replace("round(avg(", "(avg(").replace("), 6) AS", ")) AS")}
  SELECT {", ".join(f"CAST(format('{{:.5g}}', {m} * 100) AS DOUBLE) AS {m}" for m in SQ.HOTA_METRICS)}, CAST(format('{{:.5g}}', h0 * 100) AS DOUBLE) AS HOTA_0, CAST(format('{{:.5g}}', l0 * 100) AS DOUBLE) AS LocA_0, CAST(format('{{:.5g}}', h0 * l0 * 100) AS DOUBLE) AS HOTALocA_0 FROM final""")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking metrics through the summary file: percent, five significant digits."""
    path = scratch(spark, "summary")
    files.write_summary(hota.mean_over_alphas(hota.finalize(hota.combine(hota.per_sequence(*track_sets(spark, sf_dir))))), path)
    return files.read_summary(spark, path)


@query("""SELECT CAST(event_id % 3 AS INTEGER) AS step, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click, CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars appended step by step to a log, and its table of steps and metrics."""
    path = scratch(spark, "scalars")
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    for step in range(3):
        own = e.where(F.col("event_id") % 3 == step).groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        files.append_scalars(own, step, path)
    return files.dashboard(spark.read.parquet(path)).select("step", "click", "view")
