"""Queries of suppression, matching and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.operators import assign as M
from maskloom.operators import suppress as S
from maskloom.operators.overlaps import overlap_sums
from maskloom.plans import ap, cgf1, hota
from maskloom.plans import metric_sql as SQ
from maskloom.plans.views import DETECTED_SQL, PAIRS_SQL, TRUTH_SQL, detected, iou_sql, once, once_sql, overlap_sql, pairs, truth
from maskloom.shared import materialize

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("value",)})


def _greedy_sql(rows: str, groups: list[str], threshold: str) -> str:
    """Greedy suppression in SQL: rows (groups, id, box, score) one by one, with the list of kept boxes."""
    g = ", ".join(groups)
    same = " AND ".join(f"b.{c} IS NOT DISTINCT FROM r.{c}" for c in groups)
    hit = f"len(list_filter(r.kept, lambda o: ({iou_sql('o', 'b.box')}) {threshold})) > 0"
    return f"""WITH RECURSIVE b AS (SELECT {g}, id, box, row_number() OVER (PARTITION BY {g} ORDER BY score DESC NULLS LAST, id) AS k FROM {rows}),
      r AS (SELECT {g}, k, [box] AS kept, [id] AS ids FROM b WHERE k = 1 UNION ALL
        SELECT {", ".join(f"b.{c}" for c in groups)}, b.k, CASE WHEN {hit} THEN r.kept ELSE list_append(r.kept, b.box) END, CASE WHEN {hit} THEN r.ids ELSE list_append(r.ids, b.id) END FROM r JOIN b ON {same} AND b.k = r.k + 1)
      SELECT {g}, unnest(ids) AS id FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY k DESC) = 1)"""


@query(_greedy_sql(f"(SELECT image_id, dt_category AS category_id, det AS id, CASE WHEN len(dt_box) >= 4 THEN dt_box ELSE [0.0, 0.0, 0.0, 0.0] END AS box, score FROM {DETECTED_SQL} WHERE image_id IS NOT NULL)", ["image_id", "category_id"], "> 0.5"))
def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that stay per (image, category) at IoU <= 0.5, the image with a tenth of all rows included."""
    d = detected(spark, sf_dir).where("image_id IS NOT NULL")
    rows = d.select("image_id", F.col("dt_category").alias("category_id"), F.col("det").alias("id"), "score", F.col("dt_box").alias("bbox"))
    return S.suppress_boxes(rows, ["image_id", "category_id"], 0.5)


_RANKED = f"""(SELECT video_id, frame, id, box, (id * 7919 % 1000) / 1000.0 AS score FROM (SELECT video_id, id, CAST(unnest(range(len(bboxes))) AS INTEGER) AS frame, unnest(bboxes) AS box FROM {once_sql("masklet", "video_id", "bboxes")} WHERE video_id IS NOT NULL AND bboxes IS NOT NULL)
  WHERE len(box) >= 4 AND len(list_filter(box, lambda v: v > 0)) > 0)"""


@query(_greedy_sql(_RANKED, ["video_id", "frame"], ">= 0.3"))
def nms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of tracks that stay in each frame of a video, suppressed from IoU 0.3 on."""
    m = once(spark, sf_dir, "masklet", "video_id", "bboxes").where("video_id IS NOT NULL")
    f = m.select("video_id", "id", F.posexplode("bboxes").alias("frame", "bbox")).where(~B.is_zero(F.col("bbox")))
    return S.suppress_boxes(f.withColumn("score", (F.col("id") * 7919 % 1000) / 1000.0), ["video_id", "frame"], 0.3, inclusive=True)


def _track_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tracks, and pairs of a video's tracks with IoU over the frames that both have."""
    m = once(spark, sf_dir, "masklet", "video_id", "bboxes").where("video_id IS NOT NULL AND id IS NOT NULL")
    f = m.select("video_id", "id", F.posexplode("bboxes").alias("frame", "box")).where(~B.is_zero(F.col("box")))
    # frames in which the boxes don't meet add to the union only, so areas are summed over all common frames
    a, b = f.select("video_id", "frame", "id", B.area_xywh(F.col("box")).alias("area")), f.select("video_id", "frame", F.col("id").alias("other"), B.area_xywh(F.col("box")).alias("area2"))
    both = a.join(b, ["video_id", "frame"]).where("id < other").groupBy("video_id", "id", "other").agg((F.sum("area") + F.sum("area2")).alias("areas"))
    met = overlap_sums(f, f.withColumnsRenamed({"id": "other", "box": "box2"}), ["video_id", "frame"], "box", "box2", F.col("id") < F.col("other"))
    p = both.join(met.groupBy("video_id", "id", "other").agg(F.sum("inter").alias("i")), ["video_id", "id", "other"], "left").select("video_id", "id", "other", F.coalesce("i", F.lit(0.0)).alias("i"), (F.col("areas") - F.coalesce("i", F.lit(0.0))).alias("u"))
    items = m.select("video_id", "id", ((F.col("id") * 7919 % 1000) / 1000.0).alias("score"))
    return items, p.select("video_id", "id", "other", F.try_divide("i", "u").alias("similarity"))


_FR = f"(SELECT video_id, id, unnest(range(len(bboxes))) AS frame, unnest(bboxes) AS box FROM {once_sql('masklet', 'video_id', 'bboxes')} WHERE video_id IS NOT NULL AND id IS NOT NULL AND bboxes IS NOT NULL)"
_FRB = f"(SELECT * FROM {_FR} WHERE len(box) >= 4 AND len(list_filter(box, lambda v: v > 0)) > 0)"
_TRACK_IOU = f"""SELECT video_id, id, other FROM (SELECT a.video_id, a.id, b.id AS other, sum({overlap_sql('a.box', 'b.box')}) AS i,
  sum(a.box[3] * a.box[4] + b.box[3] * b.box[4] - {overlap_sql('a.box', 'b.box')}) AS u FROM {{frb}} a JOIN {{frb}} b ON a.video_id = b.video_id AND a.frame = b.frame AND a.id < b.id GROUP BY ALL) WHERE u > 0 AND i / u >= 0.3"""


@query(f"""WITH RECURSIVE e AS ({_TRACK_IOU.format(frb=_FRB)}), edge AS (SELECT * FROM e UNION ALL SELECT video_id, other, id FROM e),
  b AS (SELECT m.video_id, m.id, coalesce(n.near, []) AS near, row_number() OVER (PARTITION BY m.video_id ORDER BY (m.id * 7919 % 1000) DESC, m.id) AS k FROM {once_sql('masklet', 'video_id')} m
    LEFT JOIN (SELECT video_id, id, list(other) AS near FROM edge GROUP BY ALL) n ON n.video_id = m.video_id AND n.id = m.id WHERE m.video_id IS NOT NULL AND m.id IS NOT NULL),
  w AS (SELECT video_id, k, [id] AS kept FROM b WHERE k = 1 UNION ALL SELECT b.video_id, b.k, CASE WHEN list_has_any(w.kept, b.near) THEN w.kept ELSE list_append(w.kept, b.id) END FROM w JOIN b ON b.video_id = w.video_id AND b.k = w.k + 1)
  SELECT video_id, unnest(kept) AS id FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1)""")
def nms_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, p = _track_pairs(spark, sf_dir)
    return S.suppress_pairs(items, p, ["video_id"], lambda s: s >= 0.3)


@query(f"""SELECT video_id, id, other, round(i / u, 6) AS similarity FROM (SELECT a.video_id, a.id, b.id AS other, sum({overlap_sql('a.box', 'b.box')}) AS i,
  sum(a.box[3] * a.box[4] + b.box[3] * b.box[4] - {overlap_sql('a.box', 'b.box')}) AS u
  FROM {_FRB} a JOIN {_FRB} b ON a.video_id = b.video_id AND a.frame = b.frame AND a.id < b.id GROUP BY ALL) WHERE u > 0""")
def track_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of a video's tracks over common frames."""
    return _track_pairs(spark, sf_dir)[1].where("similarity IS NOT NULL").select("video_id", "id", "other", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH p AS (SELECT image_id AS frame, det, gt AS track, iou FROM {PAIRS_SQL} WHERE iou >= 0.1), m AS (SELECT frame, det, list(track ORDER BY track) AS tracks FROM p GROUP BY ALL)
  SELECT d.image_id AS frame, d.det, coalesce(m.tracks, []) AS tracks, coalesce(d.score >= 0.7 AND m.tracks IS NULL, FALSE) AS is_new FROM {DETECTED_SQL} d LEFT JOIN m ON d.image_id = m.frame AND d.det = m.det""")
def associate_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's matched tracks (the ground truth stands for tracks), or whether it begins one."""
    p = pairs(spark, sf_dir).select(F.col("image_id").alias("frame"), "det", F.col("gt").alias("track"), "iou")
    d = detected(spark, sf_dir).select(F.col("image_id").alias("frame"), "det", "score")
    t = truth(spark, sf_dir).select(F.col("image_id").alias("frame"), F.col("gt").alias("track"))
    return M.associate(d, t, p)[0]


@query(f"""WITH p AS (SELECT image_id, det, gt, 0.3 * score + 0.7 * iou AS s FROM {PAIRS_SQL} WHERE score IS NOT NULL), c AS (SELECT image_id, gt, quantile_cont(s, 0.5) AS cut FROM p GROUP BY ALL)
  SELECT image_id, det, gt FROM p JOIN c USING (image_id, gt) WHERE s > cut AND s > 0.4""")
def one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).where("score IS NOT NULL").select("image_id", F.col("det").alias("detection"), F.col("gt").alias("target"), F.col("score").alias("probability"), "iou")
    return M.one_to_many(p, ["image_id"], quantile=0.5).select("image_id", F.col("detection").alias("det"), F.col("target").alias("gt"))


def _optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).where("score >= 0.5 AND NOT crowd").select("image_id", F.col("gt").alias("left"), F.col("det").alias("right"), F.col("iou").alias("weight"))
    return M.assign(p, ["image_id"])


_STRONG = f"SELECT image_id, gt AS l, det AS r, iou AS w FROM {PAIRS_SQL} WHERE score >= 0.5 AND NOT crowd"


@query(f"""WITH RECURSIVE {SQ.matched(_STRONG, ["image_id"])} SELECT image_id, count(*) AS n, round(sum(w), 6) AS total FROM matched GROUP BY image_id""")
def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and total IoU of the optimal matches of each image."""
    return _optimal(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total"))


@query(f"""WITH RECURSIVE {SQ.matched(_STRONG, ["image_id"])} SELECT image_id, l AS left, r AS right, round(w, 6) AS weight FROM matched""")
def optimal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal one-to-one matches of each image's ground truth and predictions."""
    return _optimal(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"""SELECT image_id, count(*) AS n FROM (SELECT image_id, det, gt, row_number() OVER (PARTITION BY image_id, gt ORDER BY iou DESC, det) AS k FROM {PAIRS_SQL} WHERE score >= 0.5 AND NOT crowd) WHERE k = 1 GROUP BY image_id""")
def matched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth with any overlapping strong prediction, per image."""
    p = pairs(spark, sf_dir).where("score >= 0.5 AND NOT crowd")
    return p.groupBy("image_id").agg(F.count_distinct("gt").alias("n"))


def image_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = once(spark, sf_dir, "image", "is_instance_exhaustive").where("is_instance_exhaustive = 1 AND id IS NOT NULL")
    t = truth(spark, sf_dir).select("image_id", "gt", "crowd")
    d = detected(spark, sf_dir).select("image_id", "det", "score")
    p = materialize(pairs(spark, sf_dir).where("iou > 0").select("image_id", "det", "gt", "iou", "score", "crowd"), "pairs")
    return cgf1.per_unit(i.select(F.col("id").alias("image_id")), t, d, p, ["image_id"])


_N = f"""(SELECT i.id AS image_id, coalesce(g.n, 0) AS n_gt, coalesce(d.n, 0) AS n_dt FROM (SELECT id FROM {once_sql('image', 'is_instance_exhaustive')} WHERE is_instance_exhaustive = 1 AND id IS NOT NULL) i
  LEFT JOIN (SELECT image_id, count(*) AS n FROM {TRUTH_SQL} WHERE NOT crowd GROUP BY 1) g ON g.image_id = i.id LEFT JOIN (SELECT image_id, count(*) AS n FROM {DETECTED_SQL} WHERE score >= 0.5 GROUP BY 1) d ON d.image_id = i.id)"""
_UNITS = f"{SQ.matched(_STRONG, ['image_id'])}, units0 AS (SELECT n.*, m.ws FROM {_N} n LEFT JOIN (SELECT image_id, list(w) AS ws FROM matched GROUP BY 1) m USING (image_id))"
IMAGE_UNITS_SQL = _UNITS


@query(f"WITH RECURSIVE {_UNITS}, units AS (SELECT n_gt, n_dt, ws FROM units0), {SQ.cgf1()} SELECT metric, threshold, round(value, 6) AS value FROM final")
def cgf1_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cgf1.finalize(cgf1.combine(image_units(spark, sf_dir))))


@query(f"""WITH c AS (SELECT CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt > 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt > 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt = 0) AS DOUBLE) AS fn FROM {_N})
  SELECT 'IL_precision' AS metric, round(tp / (tp + fp + 1e-6), 6) AS value FROM c UNION ALL SELECT 'IL_recall', round(tp / (tp + fn + 1e-6), 6) FROM c UNION ALL SELECT 'IL_FPR', round(fp / (fp + tn + 1e-6), 6) FROM c
  UNION ALL SELECT 'IL_MCC', round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn) + 1e-6), 6) FROM c""")
def image_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cgf1.finalize(cgf1.combine(image_units(spark, sf_dir))).where("metric IN ('IL_precision', 'IL_recall', 'IL_FPR', 'IL_MCC')")
    return m.select("metric", F.round("value", 6).alias("value"))


_PAIRS3 = f"SELECT image_id, a AS annotator, gt AS l, det AS r, iou AS w FROM {PAIRS_SQL}, (SELECT unnest([0, 1, 2]) AS a) WHERE score >= 0.5 AND NOT crowd AND gt % 3 <> a"


_BEST3 = f"""{SQ.matched(_PAIRS3, ["image_id", "annotator"])}, n3 AS (SELECT n.image_id, n.n_dt, a AS annotator, coalesce(g.n, 0) AS n_gt FROM {_N} n CROSS JOIN (SELECT unnest([0, 1, 2]) AS a)
    LEFT JOIN (SELECT image_id, a, count(*) AS n FROM {TRUTH_SQL}, (SELECT unnest([0, 1, 2]) AS a) WHERE NOT crowd AND gt % 3 <> a GROUP BY 1, 2) g USING (image_id, a)),
  w3 AS (SELECT n3.*, coalesce(ws, []) AS ws FROM n3 LEFT JOIN (SELECT image_id, annotator, list(w) AS ws FROM matched GROUP BY ALL) m USING (image_id, annotator)),
  c3 AS (SELECT *, len(list_filter(ws, lambda w: w >= {SQ.THRESHOLD.format(i='i')})) AS tp FROM w3, (SELECT unnest(range(10)) AS i)),
  m3 AS (SELECT image_id, annotator, CASE WHEN any_value(n_gt) > 0 OR any_value(n_dt) > 0 THEN sum(2 * (tp / (n_dt + 1e-4)) * (tp / (n_gt + 1e-4)) / (tp / (n_dt + 1e-4) + tp / (n_gt + 1e-4) + 1e-4)) / 10 END AS m FROM c3 GROUP BY ALL),
  v3 AS (SELECT image_id, max(m) FILTER (WHERE annotator = 0) AS m0, max(m) FILTER (WHERE annotator = 1) AS m1, max(m) FILTER (WHERE annotator = 2) AS m2 FROM m3 GROUP BY 1),
  p3 AS (SELECT image_id, m2, CASE WHEN m1 IS NULL OR (m0 IS NOT NULL AND m1 > m0) THEN 1 ELSE 0 END AS b, CASE WHEN m1 IS NULL OR (m0 IS NOT NULL AND m1 > m0) THEN m1 ELSE m0 END AS m FROM v3),
  b3 AS (SELECT image_id, CASE WHEN m2 IS NULL OR (m IS NOT NULL AND m2 > m) THEN 2 ELSE b END AS annotator FROM p3)"""


def _best_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = once(spark, sf_dir, "image", "is_instance_exhaustive").where("is_instance_exhaustive = 1 AND id IS NOT NULL").select(F.col("id").alias("image_id"))
    three = lambda df: df.withColumn("annotator", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    own = F.col("gt") % 3 != F.col("annotator")
    p = materialize(three(pairs(spark, sf_dir).select("image_id", "det", "gt", "iou", "score", "crowd")).where(own), "pairs3")
    units = cgf1.per_unit(three(i), three(truth(spark, sf_dir).select("image_id", "gt", "crowd")).where(own), three(detected(spark, sf_dir).select("image_id", "det", "score")), p, ["image_id", "annotator"])
    return cgf1.best_annotator(units, ["image_id"], "annotator")


@query(f"""WITH RECURSIVE {_BEST3}, units AS (SELECT n_gt, n_dt, ws FROM w3 JOIN b3 USING (image_id, annotator)), {SQ.cgf1()} SELECT metric, threshold, round(value, 6) AS value FROM final""")
def cgf1_best_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three annotators (ground truth without a third of its rows each), the best record per image."""
    return rounded(cgf1.finalize(cgf1.combine(_best_of_three(spark, sf_dir))))


@query(f"""WITH RECURSIVE {_BEST3}, units AS (SELECT n_gt, n_dt, ws, rarity FROM w3 JOIN b3 USING (image_id, annotator) JOIN {once_sql('image', 'rarity')} i ON i.id = w3.image_id WHERE rarity BETWEEN 0 AND 3), {SQ.cgf1("rarity")},
  own AS (SELECT rarity, max(value) FILTER (WHERE metric = 'cgF1') AS cgF1, max(value) FILTER (WHERE metric = 'IL_MCC') AS IL_MCC, max(value) FILTER (WHERE metric = 'positive_micro_F1') AS positive_micro_F1 FROM final WHERE threshold IS NULL GROUP BY rarity)
  SELECT rarity, round(cgF1, 6) AS cgF1, round(IL_MCC, 6) AS IL_MCC, round(positive_micro_F1, 6) AS positive_micro_F1 FROM own UNION ALL SELECT NULL, round(avg(cgF1), 6), round(avg(IL_MCC), 6), round(avg(positive_micro_F1), 6) FROM own""")
def subset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three headline numbers of every subset (here: rarity), each image by its best of three annotators, and their
    unweighted mean over the subsets."""
    i = once(spark, sf_dir, "image", "rarity").where("rarity BETWEEN 0 AND 3").select(F.col("id").alias("image_id"), "rarity")
    return cgf1.headline(cgf1.finalize(cgf1.combine(_best_of_three(spark, sf_dir).join(i, "image_id"), ["rarity"]), ["rarity"]), "rarity")


def _ap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = once(spark, sf_dir, "image", "width", "height").withColumnRenamed("id", "image_id")
    t = truth(spark, sf_dir).join(i, "image_id").select("image_id", F.lit(0).alias("category"), "gt", "crowd", F.try_divide(B.area_xywh(F.col("gt_box")), (F.col("width") * F.col("height")).cast("double")).alias("area"))
    d = detected(spark, sf_dir).join(i, "image_id").select("image_id", F.lit(0).alias("category"), "det", "score", F.try_divide(B.area_xywh(F.col("dt_box")), (F.col("width") * F.col("height")).cast("double")).alias("area"))
    p = pairs(spark, sf_dir).select("image_id", F.lit(0).alias("category"), "det", "gt", "iou")
    return t, d, p


def _ap_sql(area: str, settings: str) -> str:
    i = once_sql("image", "width", "height")
    box = lambda b: f"({b}[3] * {b}[4])"
    return f"""WITH RECURSIVE t AS (SELECT image_id, 0 AS category, gt, crowd, {area.format(b=box('gt_box'))} AS area FROM {TRUTH_SQL} t0 JOIN {i} i ON i.id = t0.image_id),
      d AS (SELECT image_id, 0 AS category, det, score, {area.format(b=box('dt_box'))} AS area FROM {DETECTED_SQL} d0 JOIN {i} i ON i.id = d0.image_id), p AS (SELECT image_id, 0 AS category, det, gt, iou FROM {PAIRS_SQL}), {SQ.ap("image_id", settings)}"""


_RELATIVE = "{b} / nullif(CAST(width * height AS DOUBLE), 0)"
STANDARD = ap.standard_settings()
_STANDARD = ", ".join(f"('{s.name}', {'NULL, NULL' if s.area is None else f'{s.area[0]}, {s.area[1]}'}, {s.most})" for s in STANDARD)
_SUMMARY = """, mean AS (SELECT setting, avg(ap) AS ap, avg(ap) FILTER (WHERE thr_idx = 0) AS ap50, avg(ap) FILTER (WHERE thr_idx = 5) AS ap75, avg(recall) AS ar FROM final GROUP BY setting)"""


@query(_ap_sql("{b}", _STANDARD) + _SUMMARY + """ SELECT v[1] AS metric, round(coalesce(CAST(v[2] AS DOUBLE), -1), 6) AS value FROM (SELECT unnest(CASE WHEN setting = 'all' THEN [['AP', ap::VARCHAR], ['AP_50', ap50::VARCHAR], ['AP_75', ap75::VARCHAR], ['AR_100', ar::VARCHAR]]
  WHEN setting LIKE 'all@%' THEN [['AR_' || setting[5:], ar::VARCHAR]] ELSE [['AP_' || setting, ap::VARCHAR], ['AR_' || setting, ar::VARCHAR]] END) AS v FROM mean)""")
def ap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's twelve numbers: AP over all and at 0.50 and 0.75, per area range, AR at 1, 10 and 100 detections and per range."""
    t = truth(spark, sf_dir).join(once(spark, sf_dir, "image", "width").select(F.col("id").alias("image_id")), "image_id")
    t = t.select("image_id", F.lit(0).alias("category"), "gt", "crowd", B.area_xywh(F.col("gt_box")).alias("area"))
    d = detected(spark, sf_dir).join(once(spark, sf_dir, "image", "width").select(F.col("id").alias("image_id")), "image_id")
    d = d.select("image_id", F.lit(0).alias("category"), "det", "score", B.area_xywh(F.col("dt_box")).alias("area"))
    p = pairs(spark, sf_dir).select("image_id", F.lit(0).alias("category"), "det", "gt", "iou")
    return rounded(ap.standard_summary(ap.average_precisions(t, d, p, "image_id", STANDARD), STANDARD))


@query(_ap_sql(_RELATIVE, "('all', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 100)") + " SELECT category, thr_idx, round(ap, 6) AS ap, round(recall, 6) AS recall, n_gt FROM final")
def ap_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP and AR per threshold, all predictions of an image in one class."""
    return rounded(ap.average_precision(*_ap_inputs(spark, sf_dir), "image_id"), "ap", "recall")


@query(_ap_sql(_RELATIVE, "('medium', 0.01, 0.1, 100)") + _SUMMARY + " SELECT unnest(['AP', 'AP_50', 'AP_75', 'AR']) AS metric, unnest([round(coalesce(ap, -1), 6), round(coalesce(ap50, -1), 6), round(coalesce(ap75, -1), 6), round(coalesce(ar, -1), 6)]) AS value FROM mean")
def ap_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AP of boxes of medium relative area."""
    return rounded(ap.summary(ap.average_precision(*_ap_inputs(spark, sf_dir), "image_id", area=(0.01, 0.1))))


def track_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ground-truth tracks, and a tracker's made from them: boxes moved by a few pixels, every seventh track
    missing, every third one broken in two."""
    m = once(spark, sf_dir, "masklet", "video_id", "category_id", "bboxes", "areas").where("video_id IS NOT NULL AND category_id IS NOT NULL AND id IS NOT NULL")
    g = hota.phrase_frames(m)
    dx, dy = (F.col("id") % 5 - 2).cast("double"), (F.col("t") % 5 - 2).cast("double")
    box = B.make(B.at(F.col("box"), 0) + dx, B.at(F.col("box"), 1) + dy, B.at(F.col("box"), 2), B.at(F.col("box"), 3))
    r = g.where("id % 7 <> 0").select("seq", "t", (F.col("id") * 2 + F.when((F.col("id") % 3 == 0) & (F.col("t") > 4), 1).otherwise(0)).alias("id"), box.alias("box"))
    return g, r


_GF = f"""(SELECT CAST(video_id AS VARCHAR) || ':' || CAST(category_id AS VARCHAR) AS seq, id, unnest(range(len(bboxes))) AS t, unnest(bboxes) AS box, unnest(CASE WHEN areas IS NULL THEN list_transform(bboxes, lambda b: b[3] * b[4]) ELSE list_resize(areas, len(bboxes)) END) AS area
  FROM {once_sql('masklet', 'video_id', 'category_id', 'bboxes', 'areas')} WHERE video_id IS NOT NULL AND category_id IS NOT NULL AND id IS NOT NULL)"""


_TRACKS = f"""g AS (SELECT * FROM {_GF} WHERE area > 0 AND len(box) >= 4 AND len(list_filter(box, lambda v: v > 0)) > 0),
  r AS (SELECT seq, t, id * 2 + CASE WHEN id % 3 = 0 AND t > 4 THEN 1 ELSE 0 END AS id, [box[1] + id % 5 - 2, box[2] + t % 5 - 2, box[3], box[4]] AS box FROM g WHERE id % 7 <> 0),
  s AS (SELECT * FROM (SELECT g.seq, g.t, g.id AS gt, r.id AS tr, {iou_sql('r.box', 'g.box')} AS sim FROM g JOIN r ON g.seq = r.seq AND g.t = r.t) WHERE sim > 0),
  u AS (SELECT *, sum(sim) OVER (PARTITION BY seq, t, gt) + sum(sim) OVER (PARTITION BY seq, t, tr) - sim AS u FROM s), pot AS (SELECT seq, gt, tr, sum(sim / u) AS p FROM u GROUP BY ALL),
  n1 AS (SELECT seq, id AS gt, count(*) AS n_gt FROM g GROUP BY ALL), n2 AS (SELECT seq, id AS tr, count(*) AS n_tr FROM r GROUP BY ALL),
  al AS (SELECT seq, gt, tr, p / (n_gt + n_tr - p) AS align FROM pot JOIN n1 USING (seq, gt) JOIN n2 USING (seq, tr))"""
FRAME_WEIGHTS = "SELECT s.seq, s.t, s.gt AS l, s.tr AS r, align * sim AS w, sim AS x0 FROM s JOIN al USING (seq, gt, tr) WHERE align * sim > 0"
_FRAMES = SQ.matched(FRAME_WEIGHTS, ["seq", "t"], "x0")


@query(f"WITH RECURSIVE {_TRACKS} SELECT seq, gt, tr, round(align, 6) AS align FROM al")
def track_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of ground-truth and tracker tracks over all frames."""
    g, r = track_sets(spark, sf_dir)
    return hota.alignment(g, r, hota.similarities(g, r)).select("seq", "gt", "tr", F.round("align", 6).alias("align"))


@query(f"WITH RECURSIVE {_TRACKS}, {_FRAMES}, {SQ.hota(False)} SELECT * EXCLUDE (h0, l0) FROM final")
def hota_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HOTA of each (video, category), mean over the thresholds."""
    f = hota.mean_over_alphas(hota.finalize(hota.per_sequence(*track_sets(spark, sf_dir))), ["seq"])
    return f.select("seq", *(hota.f_column(m) for m in hota.METRICS))


@query(f"WITH RECURSIVE {_TRACKS}, {_FRAMES}, {SQ.hota(True)} SELECT * EXCLUDE (h0, l0), round(h0, 6) AS HOTA_0, round(l0, 6) AS LocA_0, round(h0 * l0, 6) AS HOTALocA_0 FROM final")
def hota_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = hota.mean_over_alphas(hota.finalize(hota.combine(hota.per_sequence(*track_sets(spark, sf_dir)))))
    return f.select(*(hota.f_column(m) for m in [*hota.METRICS, "HOTA_0", "LocA_0", "HOTALocA_0"]))
