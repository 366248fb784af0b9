"""Queries of the scalar functions over boxes, masks and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.functions import runs as R
from maskloom.functions import text as T
from maskloom.plans.views import PAIRS_SQL, once, once_sql, overlap_sql, pairs
from maskloom.shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WHOLE = "bbox[1] * bbox[2] * bbox[3] * bbox[4] IS NOT NULL"


@query(f"""SELECT id, CASE WHEN {_WHOLE} THEN [bbox[1], bbox[2], bbox[1] + bbox[3], bbox[2] + bbox[4]] END AS xyxy,
  CASE WHEN {_WHOLE} THEN [bbox[1] + bbox[3] / 2, bbox[2] + bbox[4] / 2, bbox[3], bbox[4]] END AS cxcywh,
  CASE WHEN {_WHOLE} THEN [bbox[1] + bbox[3] / 2, bbox[2] + bbox[4] / 2, bbox[3], bbox[4], 0.0] END AS xywha,
  CASE WHEN {_WHOLE} THEN [bbox[1] + bbox[3] / 2 - bbox[3] / 2, bbox[2] + bbox[4] / 2 - bbox[4] / 2, bbox[3], bbox[4]] END AS back FROM prediction""")
def box_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    center = B.convert(b, "xywh", "cxcywh")
    return table(spark, sf_dir, "prediction").select("id", B.convert(b, "xywh", "xyxy").alias("xyxy"), center.alias("cxcywh"), B.convert(b, "xywh", "xywha").alias("xywha"), B.convert(center, "cxcywh", "xywh").alias("back"))


@query(f"""SELECT p.id, bbox[3] * bbox[4] AS area, bbox IS NULL OR len(bbox) < 4 OR len(list_filter(bbox, lambda v: v > 0)) = 0 AS is_zero,
  CASE WHEN {_WHOLE} THEN [least(greatest(bbox[1], 0.0), CAST(width AS DOUBLE)), least(greatest(bbox[2], 0.0), CAST(height AS DOUBLE)), least(greatest(bbox[1] + bbox[3], 0.0), CAST(width AS DOUBLE)), least(greatest(bbox[2] + bbox[4], 0.0), CAST(height AS DOUBLE))] END AS clipped,
  CASE WHEN {_WHOLE} THEN [(bbox[1] + (bbox[1] + bbox[3])) / 2, (bbox[2] + (bbox[2] + bbox[4])) / 2] END AS center,
  bbox[1] + bbox[3] - bbox[1] > 0 AND bbox[2] + bbox[4] - bbox[2] > 0 AS nonempty,
  bbox[1] >= 0 AND bbox[2] >= 0 AND bbox[1] + bbox[3] < width AND bbox[2] + bbox[4] < height AS inside,
  CASE WHEN {_WHOLE} THEN [least(greatest(bbox[1] / width, 0.0), 1.0), least(greatest(bbox[2] / height, 0.0), 1.0), least(greatest(bbox[3] / width, 0.0), 1.0), least(greatest(bbox[4] / height, 0.0), 1.0)] END AS relative
  FROM {once_sql("prediction", "image_id", "bbox")} p JOIN {once_sql("image", "width", "height")} i ON p.image_id = i.id""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = once(spark, sf_dir, "image", "width", "height").withColumnRenamed("id", "image_id")
    p = once(spark, sf_dir, "prediction", "image_id", "bbox").join(i, "image_id")
    b, w, h = F.col("bbox"), F.col("width"), F.col("height")
    c = B.xywh_to_xyxy(b)
    return p.select(
        "id", B.area_xywh(b).alias("area"), B.is_zero(b).alias("is_zero"), B.clip_xyxy(c, w, h).alias("clipped"), B.center_xyxy(c).alias("center"),
        B.nonempty_xyxy(c).alias("nonempty"), B.inside_xyxy(c, w, h).alias("inside"), B.clamp(B.to_relative(b, w, h)).alias("relative"),
    )


@query("""WITH r AS (SELECT id, bbox[1] + bbox[3] / 2 AS cx, bbox[2] + bbox[4] / 2 AS cy, bbox[3] AS w, bbox[4] AS h, id % 720 - 360 AS a FROM prediction WHERE bbox[4] IS NOT NULL),
  s AS (SELECT *, abs(cos(radians(a))) AS c, abs(sin(radians(a))) AS s FROM r)
  SELECT id, (a + 180) - 360 * floor((a + 180) / 360.0) - 180 AS angle, w * h AS area, round(c * w + s * h, 6) AS upright_w, round(c * h + s * w, 6) AS upright_h,
  round(w * sqrt((2 * cos(radians(a))) ** 2 + (3 * sin(radians(a))) ** 2), 6) AS scaled_w FROM s""")
def rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "prediction").where(B.at(F.col("bbox"), 3).isNotNull())
    b = F.col("bbox")
    angle = (F.col("id") % 720 - 360).cast("double")
    r = B.make(B.at(b, 0) + B.at(b, 2) / 2, B.at(b, 1) + B.at(b, 3) / 2, B.at(b, 2), B.at(b, 3), angle)
    up = B.xyxy_to_xywh(B.xywha_to_xyxy(r))
    scaled = B.scale_xywha(r, F.lit(2.0), F.lit(3.0))
    return p.select("id", B.normal_angle(angle).alias("angle"), B.area_xywha(r).alias("area"), F.round(B.at(up, 2), 6).alias("upright_w"), F.round(B.at(up, 3), 6).alias("upright_h"), F.round(B.at(scaled, 2), 6).alias("scaled_w"))


_I = overlap_sql("dt_box", "gt_box")
_A, _G = "(dt_box[3] * dt_box[4])", "(gt_box[3] * gt_box[4])"
_HULL = "((greatest(dt_box[1] + dt_box[3], gt_box[1] + gt_box[3]) - least(dt_box[1], gt_box[1])) * (greatest(dt_box[2] + dt_box[4], gt_box[2] + gt_box[4]) - least(dt_box[2], gt_box[2])))"
_U = f"({_A} + {_G} - {_I})"


@query(f"""SELECT image_id, gt, det, round(iou, 9) AS iou, round({_I} / {_U} - ({_HULL} - {_U}) / {_HULL}, 6) AS giou, round({_I} / {_A}, 6) AS ioa_det, round({_I} / {_G}, 6) AS ioa_gt,
  round({_I} / least({_A}, {_G}), 6) AS iom FROM {PAIRS_SQL}""")
def pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU, GIoU, IoA of either box and IoM of all overlapping ground truth and predictions of an image."""
    d, g = F.col("dt_box"), F.col("gt_box")
    a, b = B.xywh_to_xyxy(d), B.xywh_to_xyxy(g)
    return pairs(spark, sf_dir).select(
        "image_id", "gt", "det", F.round("iou", 9).alias("iou"), F.round(B.giou_xyxy(a, b), 6).alias("giou"), F.round(B.ratio_or_zero(B.intersection_xywh(d, g), B.area_xywh(d)), 6).alias("ioa_det"),
        F.round(B.ratio_or_zero(B.intersection_xywh(d, g), B.area_xywh(g)), 6).alias("ioa_gt"), F.round(B.iom_xywh(d, g), 6).alias("iom"),
    )


@query(f"""WITH m AS (SELECT id, bbox, [round(bbox[1]), round(bbox[2]), ceil(bbox[3]), ceil(bbox[4])] AS r FROM prediction WHERE bbox[4] IS NOT NULL AND bbox[3] > 0 AND bbox[4] > 0)
  SELECT id, round({overlap_sql("bbox", "r")} / (bbox[3] * bbox[4] + r[3] * r[4] - {overlap_sql("bbox", "r")}), 6) AS iou, round({overlap_sql("bbox", "r")}, 6) AS inter FROM m""")
def diagonal_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row: each box and the box in whole pixels."""
    b = F.col("bbox")
    p = table(spark, sf_dir, "prediction").where((B.at(b, 3) > 0) & (B.at(b, 2) > 0) & B.at(b, 0).isNotNull())
    r = B.make(F.round(B.at(b, 0)), F.round(B.at(b, 1)), F.ceil(B.at(b, 2)).cast("double"), F.ceil(B.at(b, 3)).cast("double"))
    return p.select("id", F.round(B.iou_xywh(b, r), 6).alias("iou"), F.round(B.intersection_xywh(b, r), 6).alias("inter"))


@query("""WITH n AS (SELECT vec_id, label, embedding, lead(vec_id) OVER w AS other, lead(embedding) OVER w AS e2 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
  SELECT vec_id, other, round(greatest(0.0, 1 - sqrt(list_sum(list_transform(list_zip(embedding, e2), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))) / 20.0), 6) AS similarity FROM n WHERE other IS NOT NULL""")
def euclid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector and the next one of its label."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumns({"other": F.lead("vec_id").over(w), "e2": F.lead("embedding").over(w)}).where("other IS NOT NULL")
    d = lambda c: F.transform(c, lambda v: v.cast("double"))
    return e.select("vec_id", "other", F.round(B.euclidean_similarity(d(F.col("embedding")), d(F.col("e2")), 20.0), 6).alias("similarity"))


@query("""SELECT id, [100.0 - bbox[1], 100.0 - bbox[2], bbox[1] + bbox[3] - 100.0, bbox[2] + bbox[4] - 100.0] AS edges, round(bbox[3] * bbox[4], 6) AS polygon_area,
  [bbox[1], bbox[2], bbox[1] + bbox[3] - bbox[1], bbox[2] + bbox[4] - bbox[2]] AS keypoint_box, [bbox[1], bbox[2], bbox[1], bbox[2] + bbox[4], bbox[1] + bbox[3], bbox[2] + bbox[4], bbox[1] + bbox[3], bbox[2]] AS polygon
  FROM prediction WHERE bbox[1] + bbox[2] + bbox[3] + bbox[4] IS NOT NULL AND bbox[3] > 0 AND bbox[4] > 0""")
def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge distances of a point, the box as polygon and its area, and the box of keypoints at its corners."""
    b = F.col("bbox")
    p = table(spark, sf_dir, "prediction").where((B.at(b, 3) > 0) & (B.at(b, 2) > 0) & B.at(b, 0).isNotNull() & B.at(b, 1).isNotNull())
    poly = B.polygon_of_xywh(b)
    xs, ys = F.filter(poly, lambda v, i: i % 2 == 0), F.filter(poly, lambda v, i: i % 2 == 1)
    keypoints = F.flatten(F.zip_with(xs, ys, lambda x, y: F.array(x, y, F.lit(2.0))))
    return p.select("id", B.edge_distances(F.lit(100.0), F.lit(100.0), B.xywh_to_xyxy(b)).alias("edges"), F.round(B.polygon_area(xs, ys), 6).alias("polygon_area"), B.keypoint_box(keypoints).alias("keypoint_box"), poly.alias("polygon"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(spark, sf_dir, "masklet", "segmentations", "bboxes", "areas")
    f = m.select("id", F.posexplode(F.arrays_zip("segmentations", "bboxes", "areas")).alias("frame", "z"))
    return f.select("id", "frame", F.col("z.segmentations").alias("mask"), F.col("z.bboxes").alias("box"), F.col("z.areas").alias("area"))


_FRAMES = f"(SELECT id, i AS frame, segmentations[i + 1] AS mask, bboxes[i + 1] AS box, areas[i + 1] AS area FROM (SELECT *, unnest(range(greatest(coalesce(len(segmentations), 0), coalesce(len(bboxes), 0), coalesce(len(areas), 0)))) AS i FROM {once_sql('masklet', 'segmentations', 'bboxes', 'areas')} WHERE segmentations IS NOT NULL AND bboxes IS NOT NULL AND areas IS NOT NULL))"


@query(f"SELECT id, CAST(frame AS INTEGER) AS frame, CAST(area AS BIGINT) AS area, box FROM {_FRAMES} WHERE mask IS NOT NULL AND area IS NOT NULL AND box IS NOT NULL")
def mask_areas_and_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and box of every frame's mask, decoded; the SQL has the stored ones."""
    f = _frames(spark, sf_dir).where("mask IS NOT NULL AND area IS NOT NULL AND box IS NOT NULL")
    return f.select("id", "frame", R.mask_area(F.col("mask")).alias("area"), R.mask_box(F.col("mask")).alias("box"))


@query(f"SELECT id, CAST(frame AS INTEGER) AS frame, mask.counts AS counts FROM {_FRAMES} WHERE mask IS NOT NULL")
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks decoded to run lengths and encoded again."""
    f = _frames(spark, sf_dir).where("mask IS NOT NULL")
    return f.select("id", "frame", R.counts_text(R.mask_counts(F.col("mask"))).alias("counts"))


_NEXT = f"(SELECT id, frame, mask, box, lead(mask) OVER w AS mask2, lead(box) OVER w AS box2 FROM {_FRAMES} WINDOW w AS (PARTITION BY id ORDER BY frame))"


@query(f"""SELECT id, CAST(frame AS INTEGER) AS frame, CAST({overlap_sql('box', 'box2')} AS BIGINT) AS inter, round({overlap_sql('box', 'box2')} / (box[3] * box[4] + box2[3] * box2[4] - {overlap_sql('box', 'box2')}), 6) AS iou
  FROM {_NEXT} WHERE mask IS NOT NULL AND mask2 IS NOT NULL AND box IS NOT NULL AND box2 IS NOT NULL""")
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a track in consecutive frames; the SQL has the boxes' overlap, as the masks are rectangles."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id").orderBy("frame")
    f = _frames(spark, sf_dir).withColumns({"mask2": F.lead("mask").over(w), "box2": F.lead("box").over(w)})
    f = f.where("mask IS NOT NULL AND mask2 IS NOT NULL AND box IS NOT NULL AND box2 IS NOT NULL")
    return f.select("id", "frame", R.mask_intersection(F.col("mask"), F.col("mask2")).alias("inter"), F.round(R.mask_iou(F.col("mask"), F.col("mask2")), 6).alias("iou"))


@query()
def mask_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary length, dilated area, parts and inner centre of each annotation's mask; ``mask_boundary_overlap``
    has the boundary F of two masks."""
    a = once(spark, sf_dir, "annotation", "segmentation").where("segmentation IS NOT NULL")
    return a.select("id", R.mask_morphology(F.col("segmentation"), 3).alias("m")).select("id", "m.boundary", "m.dilated", "m.parts", "m.centre")


@query()
def mask_boundary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary F of a track's masks in consecutive frames."""
    from pyspark.sql.window import Window

    f = _frames(spark, sf_dir).withColumn("mask2", F.lead("mask").over(Window.partitionBy("id").orderBy("frame")))
    f = f.where("mask IS NOT NULL AND mask2 IS NOT NULL")
    return f.select("id", "frame", R.mask_boundary_f(F.col("mask"), F.col("mask2")).alias("f"))


@query(f"""SELECT id, CAST(max(area) AS BIGINT) AS largest, CAST(count(*) AS INTEGER) AS n FROM {_FRAMES} WHERE mask IS NOT NULL AND area IS NOT NULL GROUP BY id""")
def mask_track_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).where("mask IS NOT NULL AND area IS NOT NULL").select("id", R.mask_area(F.col("mask")).alias("a"))
    return f.groupBy("id").agg(F.max("a").alias("largest"), F.count("a").cast("int").alias("n"))


@query()
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of each track's masks: the semantic mask of its frames put together."""
    m = once(spark, sf_dir, "masklet", "segmentations")
    return m.select("id", R.mask_area(R.union_masks(F.col("segmentations"))).alias("area"))


@query(r"""SELECT id, trim(regexp_replace(text_input, '\s+', ' ', 'g')) AS squeezed, lower(trim(regexp_replace(text_input, '\s+', ' ', 'g'))) AS cleaned,
  trim(regexp_replace(lower(regexp_replace(replace(text_input, '_', ' '), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^`{|}~_]', '', 'g')), '\s+', ' ', 'g')) AS canonical,
  CASE WHEN lower(trim(text_input)) IN ('the dog', 'dog', 'quiet mushroom') THEN 'a ' || text_input ELSE text_input END AS affixed FROM image""")
def text_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text_input")
    return table(spark, sf_dir, "image").select("id", T.squeeze(t).alias("squeezed"), T.clean_lower(t).alias("cleaned"), T.canonical(t).alias("canonical"), T.with_affixes(t, "a ", "", ["the dog", "dog", "quiet mushroom"]).alias("affixed"))


@query("""SELECT id, split_part(file_name, '/', -1) AS last, array_to_string(string_split(file_name, '_')[1:greatest(len(string_split(file_name, '_')) - 1, 0)], '_') AS stem, split_part(file_name || '@' || (id % 7), '@', 1) AS file,
  CAST(id % 7 AS INTEGER) AS frame, CASE WHEN width IS NULL OR width <= 480 THEN 'u/' || id || '/full/full/0/default.jpg' ELSE 'u/' || id || '/full/!480,480/0/default.jpg' END AS url FROM image""")
def paths_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("file_name"), F.col("id")
    address = T.frame_address(F.concat(n, F.lit("@"), (i % 7).cast("string")))
    return table(spark, sf_dir, "image").select("id", F.element_at(T.path_parts(n), -1).alias("last"), T.join_but_last(n, "_", 1).alias("stem"), address["file"].alias("file"), address["frame"].alias("frame"), T.sized_url(F.lit("u"), i.cast("string"), F.col("width"), 480).alias("url"))


@query("""SELECT id, round(1 / (1 + exp(-(score * 8 - 4))), 6) AS p, round(1 / (1 + exp(-(score * 8 - 4))) * (1 / (1 + exp(-2.0))), 6) AS with_presence, 'AP@' || CAST(id % 3 AS VARCHAR) AS name, id % 5 AS colour,
  printf('#%02x%02x%02x', id % 256, id // 256 % 256, 16) AS hex FROM prediction""")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "prediction")
    logit, i = F.col("score") * 8 - 4, F.col("id")
    return p.select("id", F.round(T.sigmoid(logit), 6).alias("p"), F.round(T.presence_score(logit, F.lit(2.0)), 6).alias("with_presence"), T.thresholded_name(F.lit("AP"), i % 3).alias("name"), T.palette_index(i, 5).alias("colour"), T.rgb_to_hex(i % 256, F.floor(i / 256) % 256, F.lit(16)).alias("hex"))
