"""Queries of filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.functions import boxes as B
from maskloom.operators import filters as P
from maskloom.operators.overlaps import overlapping
from maskloom.operators.reshape import number_rows
from maskloom.plans.views import DETECTED_SQL, TRUTH_SQL, detected, iou_sql, once, once_sql, truth
from maskloom.shared import table

QUERIES, SQL = {}, {}
CHUNK = 100  #: categories of a query batch


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT category_id, count(*) FILTER (WHERE score >= 0.5) AS n_cgf1, count(*) FILTER (WHERE score > 0.5) AS n_hota, count(*) AS n_teta_off, count(*) FILTER (WHERE score >= 0.4) AS n_teta, count(*) FILTER (WHERE score > 0.6) AS n_post
  FROM (SELECT category_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM prediction) GROUP BY category_id""")
def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over thresholds by each metric's rule."""
    s = F.col("score")
    n = lambda c: F.count_if(c)
    return table(spark, sf_dir, "prediction").groupBy("category_id").agg(
        n(P.over(s, 0.5)).alias("n_cgf1"), n(P.over(s, 0.5, ">")).alias("n_hota"), n(P.over(s, 0.0, ">=", True)).alias("n_teta_off"), n(P.over(s, 0.4, ">=", True)).alias("n_teta"), n(P.over(s, 0.6, ">", True)).alias("n_post")
    )


@query("""WITH b(bucket, low, high) AS (VALUES ('all', 0, 1e5), ('tiny', 0, 0.001), ('small', 0.001, 0.01), ('medium', 0.01, 0.1), ('large', 0.1, 0.5), ('huge', 0.5, 0.95), ('whole_image', 0.95, 1e5))
  SELECT bucket, source, count(*) AS n, count(*) FILTER (WHERE coalesce(iscrowd, 0) = 0) AS n_scored FROM annotation JOIN b ON area >= low AND area <= high GROUP BY bucket, source""")
def area_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.in_buckets(table(spark, sf_dir, "annotation").select("area", "source", "iscrowd"), F.col("area"))
    return a.groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("iscrowd", F.lit(0)) == 0).alias("n_scored"))


_IMG = once_sql("image", "is_instance_exhaustive", "is_pixel_exhaustive")


@query(f"SELECT id FROM {_IMG} WHERE coalesce(is_instance_exhaustive, 0) <> 0 AND id NOT IN (SELECT id FROM {_IMG} WHERE coalesce(is_pixel_exhaustive, 0) = 0 AND id IS NOT NULL)")
def exhaustive_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to evaluate; the pixel flag stands in for a second annotator's."""
    i = once(spark, sf_dir, "image", "is_instance_exhaustive", "is_pixel_exhaustive")
    other = i.select("id", F.col("is_pixel_exhaustive").alias("is_instance_exhaustive"))
    return P.evaluable_images(i, [other]).select("id")


@query(f"SELECT det FROM {DETECTED_SQL} d WHERE EXISTS (SELECT 1 FROM {TRUTH_SQL} t WHERE t.image_id = d.image_id AND t.gt_category = d.dt_category)")
def positive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detected(spark, sf_dir).withColumnRenamed("dt_category", "category_id")
    return P.positive_split(d, truth(spark, sf_dir).withColumnRenamed("gt_category", "category_id")).select("det")


_DP = "(SELECT datapoint_id, images, find_queries FROM datapoint QUALIFY row_number() OVER (PARTITION BY datapoint_id ORDER BY delivered_at) = 1)"
_OUT = "coalesce(len(q.object_ids_output), 0)"
_AREA = "list_filter(coalesce(q.object_ids_output, []), lambda i: coalesce((images[q.image_id + 1].objects[i + 1].bbox[3] - images[q.image_id + 1].objects[i + 1].bbox[1]) * (images[q.image_id + 1].objects[i + 1].bbox[4] - images[q.image_id + 1].objects[i + 1].bbox[2]), 0) <= 0)"
_RULES = {
    "by_text": "coalesce(q.query_text NOT IN ('the dog', 'the person'), TRUE)",
    "semantic": "q.input_bbox IS NULL AND q.input_points IS NULL",
    "no_zero": f"len({_AREA}) = 0",
    "few": f"{_OUT} <= 1",
    "instance": "coalesce(q.is_exhaustive, FALSE)",
    "pixel": "coalesce(q.is_pixel_exhaustive, TRUE)",
    "geometric": f"(q.input_bbox IS NULL AND q.input_points IS NULL) OR {_OUT} > 0",
}


def _datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.operators.grouped import first_copy

    return first_copy(table(spark, sf_dir, "datapoint"), "datapoint_id").drop("delivered_at", "created_at")


@query("SELECT datapoint_id, " + ", ".join(f"CAST(len(list_filter(coalesce(find_queries, []), lambda q: {r})) AS INTEGER) AS {n}" for n, r in _RULES.items()) + f" FROM {_DP}")
def query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of queries each filter leaves, per datapoint."""
    rules = {"by_text": P.text_not_in("the dog", "the person"), "semantic": P.semantic_only, "no_zero": P.no_zero_boxes, "few": P.at_most_outputs(1), "instance": P.exhaustive_only(), "pixel": P.exhaustive_only("pixel"), "geometric": P.valid_geometric}
    d = _datapoints(spark, sf_dir)
    q = F.coalesce("find_queries", F.array())
    left = lambda rule: F.size(F.filter(q, lambda x: F.coalesce(rule(x, F.col("images")), F.lit(False))))
    return d.select("datapoint_id", *(left(r).alias(n) for n, r in rules.items()))


@query()
def filter_and_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowds and empty objects dropped, invalid queries dropped, positions and stages renumbered."""
    d = P.drop_objects(_datapoints(spark, sf_dir), lambda o: ~F.coalesce(o["is_crowd"], F.lit(False)) & (o["area"] >= 1e-6))
    d = P.drop_orphan_objects(P.keep_queries(d, P.valid_geometric))
    return d.select("datapoint_id", F.transform("images", lambda i: F.size(i["objects"])).alias("objects"), F.transform("find_queries", lambda q: F.struct(q["query_processing_order"].alias("stage"), q["object_ids_output"].alias("outputs"))).alias("queries"))


_VID = once_sql("video", "video_name", "length", "deleted_at")


@query(f"""WITH v AS (SELECT id FROM {_VID} WHERE deleted_at IS NULL) SELECT 'video' AS kind, count(*) AS n FROM v UNION ALL
  SELECT 'masklet', count(*) FROM {once_sql('masklet', 'video_id')} WHERE video_id IN (SELECT id FROM v) UNION ALL SELECT 'pair', count(*) FROM {once_sql('video_np_pair', 'video_id')} WHERE video_id IN (SELECT id FROM v)""")
def availability_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos that were never deleted, and what refers to them."""
    v = once(spark, sf_dir, "video", "deleted_at")
    left = P.availability(v, v.where("deleted_at IS NULL"), "id", {"masklet": (once(spark, sf_dir, "masklet", "video_id"), "video_id"), "pair": (once(spark, sf_dir, "video_np_pair", "video_id"), "video_id")})
    out = None
    for kind, df in left.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("video" if kind == "keys" else kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT 'prediction' AS table_name, id AS row_id, image_id AS ref FROM prediction WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT id FROM image WHERE id IS NOT NULL)
  UNION ALL SELECT 'masklet', id, video_id FROM masklet WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT id FROM video WHERE id IS NOT NULL)""")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.unknown_references(table(spark, sf_dir, "prediction").select("id", "image_id"), "image_id", table(spark, sf_dir, "image"))
    b = P.unknown_references(table(spark, sf_dir, "masklet").select("id", "video_id"), "video_id", table(spark, sf_dir, "video"))
    return a.select(F.lit("prediction").alias("table_name"), F.col("id").alias("row_id"), F.col("image_id").alias("ref")).unionByName(b.select(F.lit("masklet").alias("table_name"), F.col("id").alias("row_id"), F.col("video_id").alias("ref")))


@query("SELECT image_id, id, count(*) AS n FROM prediction GROUP BY image_id, id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repeated_ids(table(spark, sf_dir, "prediction"), ["image_id", "id"])


@query(f"SELECT id, list_transform(list_zip(bboxes, areas), lambda z: CASE WHEN coalesce(z[2], 0) > 0 AND len(z[1]) >= 4 AND len(list_filter(z[1], lambda v: v > 0)) > 0 THEN z[1] END) AS boxes FROM {once_sql('masklet', 'bboxes', 'areas')} WHERE bboxes IS NOT NULL AND areas IS NOT NULL")
def absent_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(spark, sf_dir, "masklet", "bboxes", "areas").where("bboxes IS NOT NULL AND areas IS NOT NULL")
    return m.select("id", P.absent_frames_null(F.col("bboxes"), F.col("areas")).alias("boxes"))


@query("""SELECT p.id, p.bbox[1] / i.width + p.bbox[3] / i.width / 2 < 0.025 OR p.bbox[1] / i.width + p.bbox[3] / i.width / 2 > 1 - 0.025 OR p.bbox[2] / i.height + p.bbox[4] / i.height / 2 < 0.025 OR p.bbox[2] / i.height + p.bbox[4] / i.height / 2 > 1 - 0.025 AS near,
  coalesce(length(p.segmentation.counts) > 4, FALSE) AS encoded, p.segmentation.size[1] = i.height AND p.segmentation.size[2] = i.width AS fits
  FROM """ + once_sql("prediction", "image_id", "bbox", "segmentation") + " p JOIN " + once_sql("image", "width", "height") + " i ON p.image_id = i.id WHERE p.bbox[1] + p.bbox[2] + p.bbox[3] + p.bbox[4] IS NOT NULL")
def border_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = once(spark, sf_dir, "image", "width", "height").withColumnRenamed("id", "image_id")
    p = once(spark, sf_dir, "prediction", "image_id", "bbox", "segmentation").join(i, "image_id")
    b = F.col("bbox")
    p = p.where((B.at(b, 0) + B.at(b, 1) + B.at(b, 2) + B.at(b, 3)).isNotNull())
    return p.select("id", B.near_border(B.to_relative(b, F.col("width"), F.col("height"))).alias("near"), P.long_enough(F.col("segmentation.counts")).alias("encoded"), P.same_size(F.col("width"), F.col("height"), F.col("segmentation.size")).alias("fits"))


@query(f"SELECT video_id, bool_and(tags IS NOT NULL) AS all_tagged, count(*) AS n FROM {once_sql('masklet', 'video_id', 'tags')} GROUP BY video_id HAVING bool_or(list_contains(tags, 'occluded'))")
def tagged_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with an occluded track, and whether all their tracks have tags."""
    m = once(spark, sf_dir, "masklet", "video_id", "tags").groupBy("video_id")
    return m.agg(F.bool_and(F.col("tags").isNotNull()).alias("all_tagged"), F.count(F.lit(1)).alias("n"), F.bool_or(F.array_contains("tags", "occluded")).alias("_hit")).where("_hit").drop("_hit")


@query("""SELECT 'known' AS split, count(*) AS n FROM masklet WHERE category_id IN (SELECT category_id FROM video_np_pair WHERE num_masklets > 0) UNION ALL
  SELECT 'unknown', count(*) FROM masklet m WHERE category_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM video_np_pair p WHERE p.category_id = m.category_id AND num_masklets > 0)""")
def category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of categories that occur in the pairs, and of others."""
    m = table(spark, sf_dir, "masklet").select("category_id")
    known = table(spark, sf_dir, "video_np_pair").where("num_masklets > 0").select("category_id").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("split"), "n")
    return n(m.join(known, "category_id", "left_semi"), "known").unionByName(n(m.where("category_id IS NOT NULL").join(known, "category_id", "left_anti"), "unknown"))


# Joins


@query(f"""SELECT m.id, coalesce(m.height, v.height) AS height, coalesce(m.width, v.width) AS width, coalesce(v.length, len(m.areas)) AS n_frames FROM {once_sql('masklet', 'video_id', 'height', 'width', 'areas')} m LEFT JOIN {once_sql('video', 'height', 'width', 'length')} v ON m.video_id = v.id""")
def fill_from_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(spark, sf_dir, "masklet", "video_id", "height", "width", "areas").alias("m")
    v = once(spark, sf_dir, "video", "height", "width", "length").alias("v")
    j = m.join(v, F.col("m.video_id") == F.col("v.id"), "left")
    return j.select("m.id", F.coalesce("m.height", "v.height").alias("height"), F.coalesce("m.width", "v.width").alias("width"), F.coalesce("v.length", F.when(F.col("areas").isNotNull(), F.size("areas"))).cast("long").alias("n_frames"))


@query(f"""WITH r AS (SELECT id, name, min(id) OVER (PARTITION BY lower(trim(name))) AS target FROM {once_sql('category', 'name')} WHERE id IS NOT NULL)
  SELECT p.id, coalesce(r.target, p.category_id) AS category_id, r.name FROM video_np_pair p LEFT JOIN r ON p.category_id = r.id""")
def merge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of one spelling become the first of them; unknown ones stay."""
    w = Window.partitionBy(F.lower(F.trim("name")))
    r = once(spark, sf_dir, "category", "name").where("id IS NOT NULL").select(F.col("id").alias("category_id"), "name", F.min("id").over(w).alias("target"))
    return table(spark, sf_dir, "video_np_pair").select("id", "category_id").join(r, "category_id", "left").select("id", F.coalesce("target", "category_id").alias("category_id"), "name")


@query(f"""SELECT i.id, coalesce(len(a.ids), 0) AS n, coalesce(a.ids, []) AS ids, a.ids IS NULL AS negative FROM {once_sql('image', 'width')} i LEFT JOIN (SELECT image_id, list(id ORDER BY id) AS ids FROM {once_sql('annotation', 'image_id')} WHERE id IS NOT NULL GROUP BY image_id) a ON i.id = a.image_id""")
def images_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with its annotations, also without any."""
    a = once(spark, sf_dir, "annotation", "image_id").groupBy(F.col("image_id").alias("_i")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    i = once(spark, sf_dir, "image", "width")
    none = F.array().cast("array<bigint>")
    return i.join(a, F.col("id") == F.col("_i"), "left").select("id", F.size(F.coalesce("ids", none)).cast("long").alias("n"), F.coalesce("ids", none).alias("ids"), F.col("ids").isNull().alias("negative"))


@query(f"""WITH c AS (SELECT id AS category_id, (row_number() OVER (ORDER BY id) - 1) // 100 AS chunk FROM {once_sql('category', 'name')} WHERE id IS NOT NULL),
  k AS (SELECT chunk, count(*) AS n FROM c GROUP BY chunk), p AS (SELECT DISTINCT v.video_id, c.chunk, v.category_id FROM video_np_pair v JOIN c USING (category_id))
  SELECT v.id AS video_id, k.chunk, k.n AS n_categories, count(p.category_id) AS n_positive FROM {once_sql('video', 'length')} v CROSS JOIN k LEFT JOIN p ON p.video_id = v.id AND p.chunk = k.chunk GROUP BY ALL""")
def category_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video with every chunk of 100 categories, with its positives: a query batch with negatives. All chunks
    but the last are full, so their list follows from the number of categories alone."""
    c = once(spark, sf_dir, "category", "name").where("id IS NOT NULL").select(F.col("id").alias("category_id"))
    c = number_rows(c, ["category_id"], "_n").select("category_id", F.floor(F.col("_n") / CHUNK).cast("long").alias("chunk"))
    n = c.count()
    each = F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // CHUNK).cast("long")) if n else F.array().cast("array<bigint>")
    v = once(spark, sf_dir, "video", "length").select(F.col("id").alias("video_id"), F.explode(each).alias("chunk"))
    v = v.withColumn("n_categories", F.least(F.lit(CHUNK), F.lit(n) - F.col("chunk") * CHUNK).cast("long"))
    p = table(spark, sf_dir, "video_np_pair").join(c, "category_id").groupBy("video_id", "chunk").agg(F.count_distinct("category_id").alias("n_positive"))
    return v.join(p, ["video_id", "chunk"], "left").withColumn("n_positive", F.coalesce("n_positive", F.lit(0).cast("long")))


@query(f"""SELECT a.image_id, a.gt AS a, b.gt AS b, round({iou_sql('a.gt_box', 'b.gt_box')}, 6) AS iou FROM {TRUTH_SQL} a JOIN {TRUTH_SQL} b ON a.image_id = b.image_id AND a.gt < b.gt WHERE {iou_sql('a.gt_box', 'b.gt_box')} > 0""")
def self_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ground truth of an image, each pair once."""
    t = truth(spark, sf_dir).select("image_id", "gt", "gt_box")
    a, b = t.withColumnsRenamed({"gt": "a", "gt_box": "box_a"}), t.withColumnsRenamed({"gt": "b", "gt_box": "box_b"})
    return overlapping(a, b, ["image_id"], "box_a", "box_b", condition=F.col("a") < F.col("b")).select("image_id", "a", "b", F.round("iou", 6).alias("iou"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS cond, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)
  SELECT user_id, event_id, max(CASE WHEN cond THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(CASE WHEN cond THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM e""")
def nearest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last conditioning frame before each frame, and the first at or after it."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("cond"), F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("t"))
    t = F.when(F.col("cond"), F.col("t"))
    line = w.orderBy("t")
    return e.select("user_id", "event_id", F.max(t).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min(t).over(w.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("after"))


@query(f"""SELECT coalesce(m.video_id, p.video_id) AS video_id, coalesce(m.category_id, p.category_id) AS category_id, m.n AS n_masklets, p.n AS n_pairs FROM
  (SELECT video_id, category_id, count(*) AS n FROM {once_sql('masklet', 'video_id', 'category_id')} WHERE video_id IS NOT NULL AND category_id IS NOT NULL GROUP BY ALL) m FULL JOIN
  (SELECT video_id, category_id, count(*) AS n FROM {once_sql('video_np_pair', 'video_id', 'category_id')} WHERE video_id IS NOT NULL AND category_id IS NOT NULL GROUP BY ALL) p ON m.video_id = p.video_id AND m.category_id = p.category_id""")
def merged_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two evaluators per (video, category), put side by side."""
    def n(name: str, out: str) -> DataFrame:
        return once(spark, sf_dir, name, "video_id", "category_id").where("video_id IS NOT NULL AND category_id IS NOT NULL").groupBy("video_id", "category_id").agg(F.count(F.lit(1)).alias(out))

    return n("masklet", "n_masklets").join(n("video_np_pair", "n_pairs"), ["video_id", "category_id"], "full")


# Set operations


@query("""WITH s AS (SELECT video_id, category_id, id, id % 4 AS shard FROM video_np_pair WHERE video_id IS NOT NULL), f AS (SELECT *, dense_rank() OVER (PARTITION BY video_id, category_id ORDER BY shard) AS r FROM s)
  SELECT video_id, category_id, id, shard FROM f WHERE r = 1""")
def first_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each (video, category) all rows of the first shard that has it."""
    s = table(spark, sf_dir, "video_np_pair").where("video_id IS NOT NULL").select("video_id", "category_id", "id", (F.col("id") % 4).alias("shard"))
    r = F.dense_rank().over(Window.partitionBy("video_id", "category_id").orderBy("shard"))
    return s.withColumn("r", r).where("r = 1").drop("r")


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT video_id FROM masklet INTERSECT SELECT video_id FROM video_np_pair) UNION ALL SELECT 'only_masklet', count(*) FROM (SELECT video_id FROM masklet EXCEPT SELECT video_id FROM video_np_pair)
  UNION ALL SELECT 'either', count(*) FROM (SELECT video_id FROM masklet UNION SELECT video_id FROM video_np_pair) UNION ALL SELECT 'negative', count(*) FROM video_np_pair WHERE num_masklets = 0""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = (table(spark, sf_dir, t).select("video_id") for t in ("masklet", "video_np_pair"))
    neg = table(spark, sf_dir, "video_np_pair").where("num_masklets = 0")
    out = None
    for kind, df in (("both", m.intersect(p)), ("only_masklet", m.subtract(p)), ("either", m.union(p).distinct()), ("negative", neg)):
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""WITH g AS (SELECT event_id % 50 AS track, user_id AS seq, min(event_id) AS first FROM events GROUP BY 1, 2), m AS (SELECT track FROM g GROUP BY track HAVING count(*) > 1)
  SELECT g.seq, g.track, CASE WHEN m.track IS NULL THEN g.track ELSE (SELECT max(track) FROM g) + dense_rank() OVER (ORDER BY m.track IS NULL, g.track, g.seq) END AS new_track FROM g LEFT JOIN m USING (track)""")
def unique_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track ids used in several sequences become new ones beyond the largest."""
    from maskloom.operators.reshape import unique_ids

    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("track"), F.col("user_id").alias("seq")).distinct()
    return unique_ids(e, "seq", "track").select("seq", "track", "new_track")
