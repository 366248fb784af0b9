"""Queries of reshaping, sample transforms, sessions and the tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.operators import reshape as R
from maskloom.operators import samples as X
from maskloom.operators.grouped import first_copy
from maskloom.plans import hota, session, teta
from maskloom.plans import metric_sql as SQ
from maskloom.plans.evaluating import _TRACKS, track_sets
from maskloom.plans.views import iou_sql, once, once_sql
from maskloom.shared import materialize, scratch, table
from maskloom.streaming import tracker

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TR = once_sql("masklet", "video_id", "category_id", "bboxes", "segmentations", "areas")


_ZIP = f"""SELECT id, video_id, n, CAST(i AS INTEGER) AS frame, b[i + 1] AS box, s[i + 1] AS mask, a[i + 1] AS area FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT id, video_id, coalesce(bboxes, []) AS b,
  coalesce(segmentations, []) AS s, coalesce(areas, []) AS a, greatest(len(coalesce(bboxes, [])), len(coalesce(segmentations, [])), len(coalesce(areas, []))) AS n FROM {_TR}))"""


@query(f"""WITH f AS ({_ZIP}) SELECT id, video_id, frame, box, coalesce(area, box[3] * box[4]) AS area FROM f WHERE mask IS NOT NULL OR (len(box) >= 4 AND len(list_filter(box, lambda v: v > 0)) > 0)""")
def explode_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all tracks, also of those with null or short arrays."""
    m = once(spark, sf_dir, "masklet", "video_id", "category_id", "bboxes", "segmentations", "areas")
    return R.explode_tracks(m, ["id", "video_id"]).select("id", "video_id", "frame", "box", "area")


@query(f"""WITH f AS ({_ZIP}), g AS (SELECT id, n, frame, box, mask, coalesce(area, box[3] * box[4]) AS area FROM f WHERE mask IS NOT NULL OR (len(box) >= 4 AND len(list_filter(box, lambda v: v > 0)) > 0)),
  l AS (SELECT id, max(n) AS n, list(struct_pack(f := frame, b := box, m := mask, a := area)) AS z FROM g GROUP BY id)
  SELECT id, list_transform(range(n), lambda i: list_filter(z, lambda q: q.f = i)[1].b) AS bboxes, list_transform(range(n), lambda i: list_filter(z, lambda q: q.f = i)[1].a) AS areas,
  list_transform(range(n), lambda i: list_filter(z, lambda q: q.f = i)[1].m.counts) AS counts FROM l""")
def pack_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put back into arrays of the track's length: boxes, masks and areas of all tracks."""
    m = once(spark, sf_dir, "masklet", "bboxes", "segmentations", "areas")
    longest = F.greatest(*(F.size(F.coalesce(c, F.array())) for c in ("bboxes", "segmentations", "areas")))
    f = R.explode_tracks(m.withColumn("n", longest), ["id", "n"])
    return R.pack_tracks(f, ["id"], F.col("n")).select("id", "bboxes", "areas", F.transform("segmentations", lambda m: m["counts"]).alias("counts"))


@query("""SELECT c_custkey + CASE WHEN (SELECT bool_or(c_custkey = 0) FROM customer) THEN 1 ELSE 0 END AS id, n_nationkey + CASE WHEN (SELECT bool_or(n_nationkey = 0) FROM nation) THEN 1 ELSE 0 END AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def one_based_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 1 on, for the tables that begin with 0, with what refers to them."""
    n, refs = R.one_based(table(spark, sf_dir, "nation"), "n_nationkey", {"customer": (table(spark, sf_dir, "customer"), "c_nationkey")})
    c, _ = R.one_based(refs["customer"], "c_custkey", {})
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_nationkey").alias("nation"))


_D1 = "(SELECT datapoint_id, images, find_queries FROM datapoint QUALIFY row_number() OVER (PARTITION BY datapoint_id ORDER BY delivered_at) = 1)"


def _datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_copy(table(spark, sf_dir, "datapoint").select("datapoint_id", "images", "find_queries", "delivered_at"), "datapoint_id").drop("delivered_at")


@query(f"""WITH q AS (SELECT datapoint_id, unnest(find_queries) AS q FROM {_D1}) SELECT q.query_processing_order AS stage, count(*) AS n_queries, count(DISTINCT q.query_text) AS n_texts, CAST(sum(coalesce(len(q.object_ids_output), 0)) AS BIGINT) AS n_outputs FROM q GROUP BY 1""")
def stage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries collated by stage: their number, distinct texts and outputs."""
    q = _datapoints(spark, sf_dir).select("datapoint_id", F.explode("find_queries").alias("q"))
    n = F.size(F.coalesce("q.object_ids_output", F.array().cast("array<int>"))).cast("long")
    return q.groupBy(F.col("q.query_processing_order").alias("stage")).agg(F.count(F.lit(1)).alias("n_queries"), F.count_distinct("q.query_text").alias("n_texts"), F.sum(n).alias("n_outputs"))


@query(f"""WITH d AS (SELECT datapoint_id, list_transform(images, lambda i: list_transform(coalesce(i.objects, []), lambda o: o.area)) AS a FROM {_D1}), m AS (SELECT max(len(x)) AS longest FROM (SELECT unnest(a) AS x FROM d))
  SELECT datapoint_id, list_transform(a, lambda x: CAST(len(x) AS INTEGER)) AS sizes, list_transform(a, lambda x: list_resize(x, m.longest, -1.0)) AS areas FROM d CROSS JOIN m""")
def padded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of each image's objects, padded with -1 to the longest list of the table, which is one batch here;
    ``sizes`` are the lengths without padding."""
    areas = F.transform("images", lambda i: F.transform(F.coalesce(i["objects"], F.array()), lambda o: o["area"]))
    d = materialize(_datapoints(spark, sf_dir).select("datapoint_id", areas.alias("a")), "areas")
    longest = d.agg(F.max(F.array_max(F.transform("a", F.size)))).first()[0] or 0
    return d.select("datapoint_id", F.transform("a", lambda x: F.size(x)).alias("sizes"), F.transform("a", lambda x: R.pad(x, F.lit(longest), F.lit(-1.0))).alias("areas"))


@query()
def capped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.cap_queries(_datapoints(spark, sf_dir), 2, 5, positives_first=True)
    return d.select("datapoint_id", F.transform("find_queries", lambda q: q["query_text"]).alias("texts"))


@query()
def visual_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.text_or_target(_datapoints(spark, sf_dir), 5, 0.3)
    return d.select("datapoint_id", F.transform("find_queries", lambda q: F.struct(q["query_text"].alias("text"), q["input_bbox"].alias("boxes"))).alias("queries"))


_XB = "[greatest(least(b[1] - 50, 300.0), 0.0), greatest(least(b[2] - 40, 200.0), 0.0), greatest(least(b[3] - 50, 300.0), 0.0), greatest(least(b[4] - 40, 200.0), 0.0)]"


@query(f"""WITH i AS (SELECT datapoint_id, CAST(unnest(range(len(images))) AS INTEGER) AS image, unnest(images) AS i FROM {_D1}), o AS (SELECT datapoint_id, image, unnest(i.objects) AS o FROM i), b AS (SELECT datapoint_id, image, o.object_id AS object_id, o.bbox AS b FROM o WHERE o.bbox[4] IS NOT NULL AND o.bbox[1] + o.bbox[2] + o.bbox[3] IS NOT NULL)
  SELECT datapoint_id, image, object_id, CASE WHEN ({_XB})[3] > ({_XB})[1] AND ({_XB})[4] > ({_XB})[2] THEN {_XB} END AS crop, [640 - b[3], b[2], 640 - b[1], b[4]] AS flip, [b[1] * 2, b[2] * 0.5, b[3] * 2, b[4] * 0.5] AS resize, [b[1] + 10, b[2] + 20, b[3] + 10, b[4] + 20] AS pad FROM b""")
def sample_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop, flip, resize and pad of every image's objects; ``image`` is the image's position from 0 on."""
    i = _datapoints(spark, sf_dir).select("datapoint_id", F.posexplode("images").alias("image", "i"))
    return _transformed(i.select("datapoint_id", "image", F.explode("i.objects").alias("o")), ["datapoint_id", "image"])


def _transformed(objects: DataFrame, keys: list[str]) -> DataFrame:
    o = objects.select(*keys, "o.object_id", F.col("o.bbox").alias("b"))
    o = o.where((B.at(F.col("b"), 0) + B.at(F.col("b"), 1) + B.at(F.col("b"), 2) + B.at(F.col("b"), 3)).isNotNull())
    b, none = F.col("b"), F.array().cast("array<array<double>>")
    crop, _ = X.cropped(b, none, F.lit(50.0), F.lit(40.0), F.lit(300.0), F.lit(200.0))
    return o.select(*keys, "object_id", crop.alias("crop"), B.flip_xyxy(b, F.lit(640.0)).alias("flip"), X.resized(b, F.lit(2.0), F.lit(0.5)).alias("resize"), B.pad_xyxy(b, F.lit(10.0), F.lit(20.0)).alias("pad"))


_LOG = """(SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'refine' WHEN 'purchase' THEN 'propagation_partial' ELSE 'remove' END AS type, event_id % 20 AS frame_idx, [event_id % 9] AS obj_ids FROM events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    t, i = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "click", "add").when(t == "view", "refine").when(t == "purchase", "propagation_partial").otherwise("remove")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), seq.alias("seq"), kind.alias("type"), (i % 20).alias("frame_idx"), F.array(i % 9).alias("obj_ids"))


@query(f"""WITH l AS {_LOG}, m AS (SELECT *, max(CASE WHEN type LIKE 'prop%' THEN seq END) OVER (PARTITION BY session_id) AS lp, lag(type) OVER (PARTITION BY session_id ORDER BY seq) AS before, max(seq) OVER (PARTITION BY session_id) AS last FROM l),
  t AS (SELECT session_id, list(DISTINCT obj_ids[1] ORDER BY obj_ids[1]) FILTER (WHERE seq > coalesce(lp, 0) AND type IN ('add', 'refine')) AS touched FROM m GROUP BY 1), e AS (SELECT * FROM m WHERE seq = last)
  SELECT e.session_id, CASE WHEN type LIKE 'prop%' THEN CASE WHEN coalesce(before LIKE 'prop%', FALSE) OR frame_idx IN (0, 19) THEN 'propagation_fetch' ELSE type END WHEN touched IS NOT NULL THEN 'propagation_partial' ELSE 'propagation_fetch' END AS propagation_type,
  CASE WHEN type LIKE 'prop%' THEN CASE WHEN coalesce(before LIKE 'prop%', FALSE) OR frame_idx IN (0, 19) THEN NULL ELSE obj_ids END ELSE touched END AS obj_ids FROM e JOIN t USING (session_id)""")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.plan(session.checked(_log(spark, sf_dir)), 20)


@query(f"SELECT DISTINCT session_id, obj_ids[1] AS obj_id FROM {_LOG} WHERE type IN ('add', 'refine')")
def refined_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.refined(_log(spark, sf_dir))


@query("""WITH m AS (SELECT user_id AS conv_id, event_id AS turn, CASE WHEN event_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS role, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  f AS (SELECT *, max(CASE WHEN role = 'assistant' AND event_type = 'click' AND n > 2 THEN n END) OVER (PARTITION BY conv_id) AS f FROM m) SELECT conv_id, turn, role FROM f WHERE n <= 2 OR n >= f""")
def pruned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 3 == 0, "assistant").otherwise("user").alias("role"), "event_type")
    return session.pruned(e, F.col("event_type") == "click").select("conv_id", "turn", "role")


def _track_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(spark, sf_dir, "masklet", "video_id", "bboxes").where("video_id IS NOT NULL AND bboxes IS NOT NULL")
    n = m.groupBy("video_id").agg(F.max(F.size("bboxes")).alias("n_frames"))
    f = m.select("video_id", "id", F.posexplode("bboxes").alias("frame_idx", "box")).join(n, "video_id")
    box = F.when(~B.is_zero(F.col("box")), F.col("box"))
    return tracker.frame_rows(f.select("video_id", "frame_idx", "n_frames", ((F.col("id") * 7919 % 1000) / 1000.0).alias("score"), box.alias("box")))


SETTINGS = tracker.Settings(hotstart_delay=5, unmatched_limit=3, duplicate_limit=3, confirm_after=2, new_score=0.3)


@query()
def tracker_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.track_batch(_track_frames(spark, sf_dir), SETTINGS)


@query()
def tracker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as a file stream, processed until it is used up."""
    source, out, marks = (scratch(spark, n) for n in ("frames", "tracks", "marks"))
    _track_frames(spark, sf_dir).write.parquet(source)
    stream = tracker.track_stream(spark.readStream.schema(tracker.IN).parquet(source), SETTINGS)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tracker.OUT).parquet(out)


_CLASSES = f"""{_TRACKS}, tg AS (SELECT split_part(seq, ':', 1) AS seq, t, id, split_part(seq, ':', 2) AS cls, box FROM g), tr AS (SELECT split_part(seq, ':', 1) AS seq, t, id, {{called}} AS cls, box FROM r),
  sims AS (SELECT * FROM (SELECT g.seq, g.t, g.id AS gt, r.id AS tr, g.cls AS gcls, r.cls AS rcls, {iou_sql('r.box', 'g.box')} AS sim FROM tg g JOIN tr r ON g.seq = r.seq AND g.t = r.t) WHERE sim > 0)"""
CLASSES_SQL = _CLASSES.format(called="split_part(seq, ':', 2)")
_MISNAMED = _CLASSES.format(called="CASE WHEN id % 11 = 0 THEN '1' ELSE split_part(seq, ':', 2) END")


@query(f"WITH RECURSIVE {_MISNAMED}, {SQ.teta()} SELECT cls, {', '.join(f'round({m}, 6) AS {m}' for m in [*SQ.TETA_METRICS, 'TETA'])} FROM teta")
def teta_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TETA of each class; the tracker calls every eleventh track another class."""
    g, r = track_sets(spark, sf_dir)
    split = lambda df: df.select(F.split_part("seq", F.lit(":"), F.lit(1)).alias("seq"), "t", "id", F.split_part("seq", F.lit(":"), F.lit(2)).alias("cls"), "box")
    r = split(r).withColumn("cls", F.when(F.col("id") % 11 == 0, "1").otherwise(F.col("cls")))
    out = teta.finalize(teta.combine(teta.per_sequence(split(g), r), ["cls"]), ["cls"])
    return out.select("cls", *(hota.f_column(c) for c in out.columns if c != "cls"))
