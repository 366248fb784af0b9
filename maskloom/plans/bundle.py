"""Queries of video evaluation, mask suppression and roll-ups over subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.functions import runs as R
from maskloom.operators import suppress as S
from maskloom.operators import tracks as K
from maskloom.operators.results import dangling_frames, frame_images, frame_tables
from maskloom.plans import ap, cgf1, hota, teta
from maskloom.plans import metric_sql as SQ
from maskloom.plans.evaluating import _FRB, _TRACKS, FRAME_WEIGHTS, IMAGE_UNITS_SQL, image_units, rounded, track_sets
from maskloom.plans.sampling import CLASSES_SQL
from maskloom.plans.views import once, once_sql, overlap_sql
from maskloom.shared import materialize, scratch, table
from maskloom.streaming.accumulate import Accumulator

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH f AS {_FRB}, d AS (SELECT video_id, frame, id * 2 AS id, [box[1] + 3, box[2] + 1, box[3], box[4]] AS box FROM f WHERE id % 7 <> 0 AND frame % 4 <> 3),
  i AS (SELECT f.video_id, f.id AS gt, d.id AS det, sum({overlap_sql('d.box', 'f.box')}) AS i FROM f JOIN d ON f.video_id = d.video_id AND f.frame = d.frame GROUP BY ALL),
  a AS (SELECT video_id, id, sum(greatest(box[3] * box[4], 0)) AS a FROM f GROUP BY ALL), b AS (SELECT video_id, id, sum(greatest(box[3] * box[4], 0)) AS b FROM d GROUP BY ALL)
  SELECT i.video_id, gt, det, round(i / (a + b - i), 6) AS iou FROM i JOIN a ON a.video_id = i.video_id AND a.id = gt JOIN b ON b.video_id = i.video_id AND b.id = det WHERE i > 0""")
def evaluation_track_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of tracks where frames of only one of them count in the union."""
    m = once(spark, sf_dir, "masklet", "video_id", "bboxes").where("video_id IS NOT NULL AND id IS NOT NULL")
    f = m.select("video_id", "id", F.posexplode("bboxes").alias("t", "box")).where(~B.is_zero(F.col("box")))
    moved = B.make(B.at(F.col("box"), 0) + 3, B.at(F.col("box"), 1) + 1, B.at(F.col("box"), 2), B.at(F.col("box"), 3))
    d = f.where("id % 7 <> 0 AND t % 4 <> 3").select("video_id", "t", (F.col("id") * 2).alias("id"), moved.alias("box"))
    return K.track_pairs(f, d, ["video_id"]).select("video_id", "gt", "det", F.round("iou", 6).alias("iou"))


def _video(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Units, truth, detections and pairs per (video, category), negatives included."""
    g, r = track_sets(spark, sf_dir)
    pairs = materialize(K.track_pairs(g, r, ["seq"]), "track-pairs")
    p = once(spark, sf_dir, "video_np_pair", "video_id", "category_id").where("video_id IS NOT NULL AND category_id IS NOT NULL")
    units = p.select(F.concat_ws(":", F.col("video_id").cast("string"), F.col("category_id").cast("string")).alias("seq")).unionByName(g.select("seq")).distinct()
    truth = g.groupBy("seq", F.col("id").alias("gt")).agg(F.lit(False).alias("crowd"), F.avg(B.area_xywh(F.col("box"))).alias("area"))
    dets = r.groupBy("seq", F.col("id").alias("det")).agg(F.avg(B.area_xywh(F.col("box"))).alias("area")).withColumn("score", (F.col("det") * 7919 % 1000) / 1000.0)
    return units, truth, dets, pairs.join(dets.select("seq", "det", "score"), ["seq", "det"]).withColumn("crowd", F.lit(False))


# Pairs of tracks, units and counts of (video, category) pairs in SQL
_VIDEO = f"""{_TRACKS}, area AS (SELECT seq, id, sum(greatest(box[3] * box[4], 0)) AS a FROM g GROUP BY ALL), arear AS (SELECT seq, id, sum(greatest(box[3] * box[4], 0)) AS a FROM r GROUP BY ALL),
  meet AS (SELECT g.seq, g.id AS gt, r.id AS det, sum({overlap_sql('r.box', 'g.box')}) AS i FROM g JOIN r ON g.seq = r.seq AND g.t = r.t GROUP BY ALL),
  vp AS (SELECT m.seq, gt, det, i / (x.a + y.a - i) AS iou, (det * 7919 % 1000) / 1000.0 AS score FROM meet m JOIN area x ON x.seq = m.seq AND x.id = gt JOIN arear y ON y.seq = m.seq AND y.id = det WHERE i > 0),
  vt AS (SELECT seq, id AS gt, FALSE AS crowd, avg(box[3] * box[4]) AS area FROM g GROUP BY ALL), vd AS (SELECT seq, id AS det, (id * 7919 % 1000) / 1000.0 AS score, avg(box[3] * box[4]) AS area FROM r GROUP BY ALL),
  vu AS (SELECT DISTINCT CAST(video_id AS VARCHAR) || ':' || CAST(category_id AS VARCHAR) AS seq FROM {once_sql('video_np_pair', 'video_id', 'category_id')} WHERE video_id IS NOT NULL AND category_id IS NOT NULL UNION SELECT seq FROM g)"""
_VIDEO_UNITS = f"""{SQ.matched("SELECT seq, gt AS l, det AS r, iou AS w FROM vp WHERE score >= 0.5", ["seq"])}, units AS (SELECT vu.seq, coalesce(a.n, 0) AS n_gt, coalesce(b.n, 0) AS n_dt, ws FROM vu
  LEFT JOIN (SELECT seq, count(*) AS n FROM vt GROUP BY 1) a USING (seq) LEFT JOIN (SELECT seq, count(*) AS n FROM vd WHERE score >= 0.5 GROUP BY 1) b USING (seq) LEFT JOIN (SELECT seq, list(w) AS ws FROM matched GROUP BY 1) m USING (seq))"""


def _video_ap_sql(category: str) -> str:
    own = f"t AS (SELECT seq, {category} AS category, gt, crowd, area FROM vt), d AS (SELECT seq, {category} AS category, det, score, area FROM vd), p AS (SELECT seq, {category} AS category, det, gt, iou FROM vp)"
    # the names t, d and p are taken only here
    return f"""WITH RECURSIVE {_VIDEO}, {own}, {SQ.ap("seq", "('all', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 100)")}, mean AS (SELECT avg(ap) AS ap, avg(ap) FILTER (WHERE thr_idx = 0) AS ap50, avg(ap) FILTER (WHERE thr_idx = 5) AS ap75, avg(recall) AS ar FROM final)
      SELECT unnest(['AP', 'AP_50', 'AP_75', 'AR']) AS metric, unnest([round(coalesce(ap, -1), 6), round(coalesce(ap50, -1), 6), round(coalesce(ap75, -1), 6), round(coalesce(ar, -1), 6)]) AS value FROM mean"""


@query(f"""WITH RECURSIVE {_VIDEO}, {_VIDEO_UNITS} SELECT seq, n_gt, n_dt, len(list_filter(coalesce(ws, []), lambda w: w >= 0.5)) AS tp, n_dt - len(list_filter(coalesce(ws, []), lambda w: w >= 0.5)) AS fp, n_gt - len(list_filter(coalesce(ws, []), lambda w: w >= 0.5)) AS fn FROM units""")
def video_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters at IoU 0.5 of each (video, category) pair."""
    u = cgf1.per_unit(*_video(spark, sf_dir), ["seq"])
    tp = F.col("tp")[0]
    return u.select("seq", "n_gt", "n_dt", tp.alias("tp"), (F.col("n_dt") - tp).alias("fp"), (F.col("n_gt") - tp).alias("fn"))


@query(f"WITH RECURSIVE {_VIDEO}, {_VIDEO_UNITS}, {SQ.cgf1()} SELECT metric, threshold, round(value, 6) AS value FROM final")
def cgf1_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with correlation of (video, category) pairs over track IoU."""
    units, truth, dets, pairs = _video(spark, sf_dir)
    return rounded(cgf1.finalize(cgf1.combine(cgf1.per_unit(units, truth, dets, pairs, ["seq"]))))


def _phrase_ap(spark: SparkSession, sf_dir: str, with_categories: bool) -> DataFrame:
    _, truth, dets, pairs = _video(spark, sf_dir)
    cat = F.split_part("seq", F.lit(":"), F.lit(2)).cast("long") if with_categories else F.lit(0).cast("long")
    own = lambda df: df.withColumn("category", cat)
    return ap.average_precision(own(truth), own(dets), own(pairs.select("seq", "det", "gt", "iou")), "seq")


@query(_video_ap_sql("0"))
def ap_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP of tracks, all phrases as one class."""
    return rounded(ap.summary(_phrase_ap(spark, sf_dir, False)))


@query(_video_ap_sql("CAST(split_part(seq, ':', 2) AS BIGINT)"))
def ap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AP of tracks over the categories."""
    return rounded(ap.summary(_phrase_ap(spark, sf_dir, True)))


_HOTA_ONE = f"""WITH RECURSIVE {_TRACKS}, {SQ.matched(FRAME_WEIGHTS, ["seq", "t"], "x0")}, {SQ.hota(True)} SELECT * EXCLUDE (h0, l0), round(h0, 6) AS HOTA_0, round(l0, 6) AS LocA_0, round(h0 * l0, 6) AS HOTALocA_0 FROM final"""
_TETA_ONE = f"""WITH RECURSIVE {CLASSES_SQL}, {SQ.teta()} SELECT {", ".join(f"round(avg({m}), 6) AS {m}" for m in [*SQ.TETA_METRICS, "TETA"])} FROM teta"""


@query(f"""SELECT 'cgf1' AS evaluator, metric, value FROM ({SQL["cgf1_video"]}) WHERE threshold IS NULL UNION ALL SELECT 'phrase_ap', metric, value FROM ({SQL["ap_phrases"]}) UNION ALL SELECT 'class_ap', metric, value FROM ({SQL["ap_classes"]})
  UNION ALL SELECT 'phrase_hota', metric, value FROM (UNPIVOT ({_HOTA_ONE}) ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'teta', metric, value FROM (UNPIVOT ({_TETA_ONE}) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def video_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All video metrics in one table: evaluator, metric, value."""
    long = lambda df, name: df.unpivot([], df.columns, "metric", "value").select(F.lit(name).alias("evaluator"), "metric", F.round(F.col("value").cast("double"), 6).alias("value"))
    g, r = track_sets(spark, sf_dir)
    split = lambda df: df.select(F.split_part("seq", F.lit(":"), F.lit(1)).alias("seq"), "t", "id", F.split_part("seq", F.lit(":"), F.lit(2)).alias("cls"), "box")
    h = hota.mean_over_alphas(hota.finalize(hota.combine(hota.per_sequence(g, r))))
    t = teta.class_averaged(teta.finalize(teta.combine(teta.per_sequence(split(g), split(r)), ["cls"]), ["cls"]))
    c = cgf1_video(spark, sf_dir).where("threshold IS NULL").select(F.lit("cgf1").alias("evaluator"), "metric", "value")
    one = lambda df, name: df.select(F.lit(name).alias("evaluator"), "metric", "value")
    return c.unionByName(one(ap_phrases(spark, sf_dir), "phrase_ap")).unionByName(one(ap_classes(spark, sf_dir), "class_ap")).unionByName(long(h, "phrase_hota")).unionByName(long(t, "teta"))


@query()
def mask_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a video's frame that stay at IoU <= 0.3 after a score filter, by IoM <= 0.3 in ``iom``."""
    m = once(spark, sf_dir, "masklet", "video_id", "segmentations").where("video_id IS NOT NULL AND id IS NOT NULL")
    f = m.select("video_id", "id", F.posexplode("segmentations").alias("frame", "mask")).where("mask IS NOT NULL")
    f = f.withColumn("score", (F.col("id") * 7919 % 1000) / 1000.0).where("score > 0.2")
    keys = ["video_id", "frame"]
    iou = S.suppress_pairs(f, K.mask_pairs(f, keys), keys, lambda s: s > 0.3).withColumn("iou", F.lit(True))
    iom = S.suppress_pairs(f, K.mask_pairs(f, keys, "iom"), keys, lambda s: s > 0.3).withColumn("iom", F.lit(True))
    return iou.join(iom, [*keys, "id"], "full").select(*keys, "id", F.coalesce("iou", F.lit(False)).alias("iou"), F.coalesce("iom", F.lit(False)).alias("iom"))


@query()
def masks_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each mask of a frame after overlaps went to the better score."""
    m = once(spark, sf_dir, "masklet", "video_id", "segmentations").where("video_id IS NOT NULL AND id IS NOT NULL")
    f = m.select("video_id", "id", F.posexplode("segmentations").alias("frame", "mask")).where("mask IS NOT NULL").withColumn("score", (F.col("id") * 7919 % 1000) / 1000.0)
    return K.resolved(f, ["video_id", "frame"]).select("video_id", "frame", "id", R.mask_area(F.col("mask")).alias("area"))


@query(f"""WITH RECURSIVE {IMAGE_UNITS_SQL}, units AS (SELECT u.*, i.rarity FROM units0 u JOIN {once_sql('image', 'rarity')} i ON i.id = u.image_id WHERE rarity BETWEEN 0 AND 3), {SQ.cgf1("rarity")},
  own AS (SELECT * FROM final WHERE metric = 'cgF1') SELECT rarity, metric, threshold, round(value, 6) AS value FROM own UNION ALL SELECT NULL, metric, threshold, round(avg(value), 6) FROM own GROUP BY metric, threshold""")
def cgf1_by_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric per rarity and, as ``rarity`` null, its unweighted mean over them."""
    i = once(spark, sf_dir, "image", "rarity").select(F.col("id").alias("image_id"), "rarity").where("rarity BETWEEN 0 AND 3")
    f = cgf1.finalize(cgf1.combine(image_units(spark, sf_dir).join(i, "image_id"), ["rarity"]), ["rarity"]).where("metric = 'cgF1'")
    mean = f.groupBy("metric", "threshold").agg(F.avg("value").alias("value")).select(F.lit(None).cast("int").alias("rarity"), "metric", "threshold", "value")
    return rounded(f.unionByName(mean))


@query(f"SELECT id, video_id, segmentations[3].counts AS counts, bboxes[3] AS box FROM {once_sql('masklet', 'video_id', 'segmentations', 'bboxes')} WHERE segmentations[3] IS NOT NULL OR bboxes[3] IS NOT NULL")
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(spark, sf_dir, "masklet", "video_id", "segmentations", "bboxes")
    return K.frame_of_track(m, 2).select("id", "video_id", F.col("mask.counts").alias("counts"), "box")


_VIDEO_FRAMES = f"(SELECT id AS video_id, CAST(unnest(range(len(file_names))) AS INTEGER) AS frame_index FROM {once_sql('video', 'file_names')} WHERE id IS NOT NULL)"


@query(f"SELECT video_id, frame_index, row_number() OVER (ORDER BY video_id, frame_index) AS id FROM {_VIDEO_FRAMES}")
def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of all videos' frames, numbered."""
    return frame_images(_videos(spark, sf_dir)).select("video_id", "frame_index", "id")


_TRACK_FRAMES = f"""(WITH m AS (SELECT id AS track_id, video_id, category_id, iscrowd, coalesce(bboxes, []) AS b, coalesce(segmentations, []) AS s, coalesce(areas, []) AS a FROM {once_sql('masklet', 'video_id', 'category_id', 'iscrowd', 'bboxes', 'segmentations', 'areas')}),
  u AS (SELECT *, unnest(range(greatest(len(b), len(s), len(a)))) AS i FROM m), f AS (SELECT track_id, video_id, category_id, iscrowd, CAST(i AS INTEGER) AS frame_index, b[i + 1] AS bbox, s[i + 1] AS mask, a[i + 1] AS area FROM u)
  SELECT track_id, video_id, category_id, iscrowd, frame_index, bbox, mask, coalesce(area, bbox[3] * bbox[4]) AS area FROM f WHERE mask IS NOT NULL OR (len(bbox) >= 4 AND len(list_filter(bbox, lambda v: v > 0)) > 0))"""


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "video", "file_names", "height", "width").where("id IS NOT NULL")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "masklet", "video_id", "category_id", "iscrowd", "bboxes", "segmentations", "areas")


@query(f"""WITH i AS (SELECT video_id, frame_index, row_number() OVER (ORDER BY video_id, frame_index) AS image_id FROM {_VIDEO_FRAMES})
  SELECT row_number() OVER (ORDER BY video_id, frame_index, track_id) AS id, image_id, track_id, video_id, frame_index, category_id, iscrowd, bbox, area, mask.counts AS counts FROM {_TRACK_FRAMES} t JOIN i USING (video_id, frame_index)""")
def frame_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all tracks, numbered, with their images' numbers; those without an image are in ``frame_dangling``."""
    a = frame_tables(_videos(spark, sf_dir), _tracks(spark, sf_dir), strict=False)["annotations"]
    return a.select("id", "image_id", "track_id", "video_id", "frame_index", "category_id", "iscrowd", "bbox", "area", F.col("segmentation.counts").alias("counts"))


@query(f"""SELECT track_id, t.video_id, frame_index, CASE WHEN t.video_id IS NULL THEN 'null' WHEN v.id IS NULL THEN 'video' ELSE 'frame' END AS reason FROM {_TRACK_FRAMES} t
  LEFT JOIN {once_sql('video', 'file_names')} v ON t.video_id = v.id WHERE v.id IS NULL OR frame_index >= coalesce(len(v.file_names), 0)""")
def frame_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks' frames that refer to no video or to a missing video or frame."""
    return dangling_frames(_videos(spark, sf_dir), _tracks(spark, sf_dir)).select("track_id", "video_id", "frame_index", "reason")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def streamed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters accumulated over the micro-batches of a file stream."""
    source, folder, marks = (scratch(spark, n) for n in ("events", "counters", "marks"))
    table(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(source)
    acc = Accumulator(spark, folder, ["event_type"], ["n", "cents"])
    per_unit = lambda b: b.select("event_type", F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(acc.sink(per_unit)).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return acc.current()
