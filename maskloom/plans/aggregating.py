"""Queries of aggregates, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.operators import aggregates as A
from maskloom.operators import ordered as O
from maskloom.operators.reshape import number_rows, relabel
from maskloom.plans.views import once, once_sql
from maskloom.shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_returnflag AS grp, round(sum(l_quantity * l_extendedprice) / greatest(1.0, sum(l_extendedprice)), 6) AS weighted, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (WHERE l_discount > 0.05) AS n_over,
  round(coalesce(avg(nullif(CASE WHEN l_linenumber = 3 THEN -1.0 ELSE l_quantity END, -1.0)), -1.0), 6) AS defined, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag""")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(
        F.round(A.weighted_mean(q, F.col("l_extendedprice")), 6).alias("weighted"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_discount") > 0.05).alias("n_over"),
        F.round(A.mean_of_defined(F.when(F.col("l_linenumber") == 3, -1.0).otherwise(q)), 6).alias("defined"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"),
    )


@query("""WITH g AS (SELECT p_brand, avg(l_quantity) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
  SELECT round((SELECT avg(m) FROM g), 6) AS mean_of_means, round(avg(l_quantity), 6) AS flat FROM lineitem JOIN part ON l_partkey = p_partkey""")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the brands' means beside the mean of all lines, from one aggregation."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_brand").agg(F.sum("l_quantity").alias("s"), F.count("l_quantity").alias("n"))
    return g.agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("mean_of_means"), F.round(F.sum("s") / F.sum("n"), 6).alias("flat"))


@query(f"""SELECT video_id, category_id, CAST(grouping_id(video_id, category_id) AS INTEGER) AS level, CAST(sum(n_frames) AS BIGINT) AS n_frames, CAST(sum(n_boxes) AS BIGINT) AS n_boxes FROM
  (SELECT video_id, category_id, len(areas) AS n_frames, len(list_filter(areas, lambda v: v IS NOT NULL)) AS n_boxes FROM {once_sql('masklet', 'video_id', 'category_id', 'areas')} WHERE areas IS NOT NULL)
  GROUP BY GROUPING SETS ((video_id, category_id), (category_id), ())""")
def hierarchical_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per (video, category), per category and in all."""
    m = once(spark, sf_dir, "masklet", "video_id", "category_id", "areas").where("areas IS NOT NULL")
    c = m.select("video_id", "category_id", F.size("areas").cast("long").alias("n_frames"), F.size(F.filter("areas", lambda v: v.isNotNull())).cast("long").alias("n_boxes"))
    return A.roll_up(c, "video_id", "category_id", ["n_frames", "n_boxes"])


@query("""WITH c AS (SELECT s_nationkey, count(*) AS tp, sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS fp FROM supplier GROUP BY s_nationkey),
  n AS (SELECT n_regionkey, n_nationkey, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM nation LEFT JOIN c ON s_nationkey = n_nationkey)
  SELECT n_regionkey AS region, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, round(sum(tp) / greatest(1, sum(tp) + sum(fp)), 6) AS det_averaged, round(avg(tp / greatest(1, tp + fp)), 6) AS cls_averaged,
  round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END), 6) AS cls_averaged_nonempty FROM n GROUP BY n_regionkey""")
def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and class averages of a ratio per super-class, with and without empty classes."""
    c = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("tp"), F.count_if(F.col("s_acctbal") < 0).alias("fp"))
    zero = F.lit(0).cast("long")
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_regionkey", F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"))
    ratio = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    return n.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.round(F.sum("tp") / F.greatest(F.lit(1), F.sum("tp") + F.sum("fp")), 6).alias("det_averaged"),
        F.round(F.avg(ratio), 6).alias("cls_averaged"), F.round(F.avg(F.when(F.col("tp") + F.col("fp") > 0, ratio)), 6).alias("cls_averaged_nonempty"),
    )


@query("""WITH c AS (SELECT image_id, category_id, count(*) AS n FROM prediction WHERE category_id IS NOT NULL AND image_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, category_id) AS k FROM c)
  SELECT image_id, category_id FROM r WHERE k = 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "prediction").where("image_id IS NOT NULL").select("image_id", "category_id", F.lit(1.0).alias("one"))
    return A.majority(p, ["image_id"], "category_id", "one").select("image_id", "category_id")


@query(f"""SELECT id, round(list_sum(list_transform(areas, lambda v: coalesce(v, 0))) / nullif(len(areas), 0), 6) AS with_zeros, round(list_avg(list_filter(areas, lambda v: v > 0)), 6) AS present FROM {once_sql('masklet', 'areas')} WHERE areas IS NOT NULL""")
def mean_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(spark, sf_dir, "masklet", "areas").where("areas IS NOT NULL")
    return m.select("id", F.round(A.mean_area_with_zeros(F.col("areas")), 6).alias("with_zeros"), F.round(A.mean_area_present(F.col("areas")), 6).alias("present"))


@query(f"""WITH i AS (SELECT id, rarity FROM {once_sql('image', 'rarity')} WHERE rarity BETWEEN 0 AND 3), p AS (SELECT image_id, count(*) FILTER (WHERE score >= 0.5 AND NOT isnan(score)) AS n FROM {once_sql('prediction', 'image_id', 'score')} GROUP BY image_id)
  SELECT rarity, round(avg(coalesce(n, 0)), 6) AS mean_counted, count(*) AS n_images FROM i LEFT JOIN p ON i.id = p.image_id GROUP BY rarity""")
def rarity_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections counted per image, averaged by rarity."""
    i = once(spark, sf_dir, "image", "rarity").where("rarity BETWEEN 0 AND 3")
    s = F.col("score")
    p = once(spark, sf_dir, "prediction", "image_id", "score").groupBy(F.col("image_id").alias("_i")).agg(F.count_if((s >= 0.5) & ~F.isnan(s)).alias("n"))
    return i.join(p, F.col("id") == F.col("_i"), "left").groupBy("rarity").agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_counted"), F.count(F.lit(1)).alias("n_images"))


_E = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_type IN ('click', 'view') AS hit FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", t.alias("t"), F.col("event_type").isin("click", "view").alias("hit"))


@query(f"""WITH i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS island FROM {_E}), r AS (SELECT *, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY t) AS BIGINT) AS run FROM i)
  SELECT user_id, t, run, max(run) OVER (PARTITION BY user_id ORDER BY t) >= 3 AS confirmed FROM r""")
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = O.match_runs(_events(spark, sf_dir), ["user_id"], "t", F.col("hit"))
    return O.confirmed(r, ["user_id"], "t", "run", 3).select("user_id", "t", "run", "confirmed")


@query(f"""WITH e AS {_E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e)
  SELECT user_id, t, CASE WHEN t + 2 > n THEN last_value(event_type) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY t) END AS ahead,
  max(CASE WHEN NOT hit THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS last_miss FROM n""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = O.look_ahead(_events(spark, sf_dir), ["user_id"], "t", "event_type", 2, "ahead")
    return O.carried_forward(e, ["user_id"], "t", ~F.col("hit"), "last_miss").select("user_id", "t", "ahead", "last_miss")


@query(f"SELECT user_id, event_id FROM {_E} WHERE t - 1 BETWEEN 2 AND 40 AND (t - 3) % 5 = 0")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.strided(_events(spark, sf_dir), ["user_id"], "t", 2, 40, 5).select("user_id", "event_id")


@query(f"""WITH RECURSIVE e AS {_E}, r AS (SELECT user_id, t, CASE WHEN hit THEN least(5 + 1, 8) ELSE greatest(5 - 1, -1) END AS alive FROM e WHERE t = 1
  UNION ALL SELECT e.user_id, e.t, CASE WHEN e.hit THEN least(r.alive + 1, 8) ELSE greatest(r.alive - 1, -1) END FROM r JOIN e ON e.user_id = r.user_id AND e.t = r.t + 1) SELECT user_id, t, CAST(alive AS INTEGER) AS alive FROM r""")
def saturating_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.keep_alive(_events(spark, sf_dir), ["user_id"], "t", F.col("hit"), 5, -1, 8)


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def stable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_k(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 10).select("user_id", "event_id", "rank")


@query("""SELECT user_id, arg_min(event_id, ts + to_microseconds(event_id)) AS first, arg_max(event_id, ts + to_microseconds(event_id)) AS last FROM events GROUP BY user_id""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id"))
    return O.first_and_last(e, ["user_id"], "at", "event_id")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def best_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", O.best_label(F.col("embedding")).alias("best"))


@query("""SELECT video_id, category_id, dense_rank() OVER (PARTITION BY video_id ORDER BY category_id) - 1 AS label, dense_rank() OVER (PARTITION BY video_id ORDER BY category_id DESC) - 1 AS back
  FROM (SELECT DISTINCT video_id, category_id FROM video_np_pair WHERE video_id IS NOT NULL AND category_id IS NOT NULL)""")
def contiguous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "video_np_pair").where("video_id IS NOT NULL AND category_id IS NOT NULL").select("video_id", "category_id").distinct()
    both = relabel(relabel(p, ["video_id"], "category_id", "label"), ["video_id"], "category_id", "back", True)
    return both.select("video_id", "category_id", F.col("label").cast("long").alias("label"), F.col("back").cast("long").alias("back"))


@query("SELECT video_id, category_id, row_number() OVER (ORDER BY video_id, category_id) AS number FROM (SELECT DISTINCT video_id, category_id FROM video_np_pair WHERE video_id IS NOT NULL AND category_id IS NOT NULL)")
def global_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New consecutive ids of (video, category) pairs, in order."""
    p = table(spark, sf_dir, "video_np_pair").where("video_id IS NOT NULL AND category_id IS NOT NULL").select("video_id", "category_id").distinct()
    return number_rows(p, ["video_id", "category_id"], "number", 1)


@query("SELECT image_id, count(*) AS n FROM prediction WHERE image_id IS NOT NULL GROUP BY image_id HAVING count(*) <= 10")
def capped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of at most 10 rows, as a loader takes them."""
    return table(spark, sf_dir, "prediction").where("image_id IS NOT NULL").groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 10")


@query("""WITH w AS (SELECT label, vec_id, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY embedding[1] DESC, vec_id) AS k, vec_id % 50 AS q FROM embeddings)
  SELECT CAST(count(*) FILTER (WHERE k = 1 AND label = q % 10) AS BIGINT) AS top1, CAST(count(DISTINCT q) FILTER (WHERE k <= 5 AND label = q % 10) AS BIGINT) AS top5 FROM w""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose label is the best, or among the best five, candidates."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") % 50).alias("q"), F.get("embedding", F.lit(0)).alias("s"))
    r = O.top_k(e, ["q"], [F.col("s").desc(), F.col("vec_id")], 5)
    hit = F.col("label") == F.col("q") % 10
    return r.agg(F.count_if((F.col("rank") == 1) & hit).alias("top1"), F.count_distinct(F.when(hit, F.col("q"))).alias("top5"))
