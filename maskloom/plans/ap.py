"""Average precision and recall over recall levels, as published for the common detection benchmark.

Matching is greedy by score. Precision at a recall level is the greatest precision at that recall or more,
and it is reached at a true positive, so only these are kept per threshold; what is needed of the other
detections is how many there are before. These counts are prefix sums in two steps, within parts of about as many
rows, in the order of all detections, and over the parts' totals, so that a category with most rows is not one
task, nor are equal scores. Per recall level (of 101) the greatest precision is one aggregation, and the envelope
a maximum over at most 101 rows. Area ranges and limits of detections are settings, all evaluated in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.operators.assign import greedy_by_score
from maskloom.plans.cgf1 import THRESHOLDS
from maskloom.shared import materialize

@dataclass(frozen=True)
class Setting:
    """An evaluation: area range (None: any) and the most detections of a (unit, category)."""

    name: str
    area: tuple[float, float] | None = None
    most: int = 100


def average_precision(truth: DataFrame, detections: DataFrame, pairs: DataFrame, unit: str, thresholds: list[float] = THRESHOLDS, most: int = 100, area: tuple[float, float] | None = None) -> DataFrame:
    """category, thr_idx, ap, recall, n_gt of one setting; see ``average_precisions``."""
    return average_precisions(truth, detections, pairs, unit, [Setting("all", area, most)], thresholds).drop("setting")


def average_precisions(truth: DataFrame, detections: DataFrame, pairs: DataFrame, unit: str, settings: list[Setting], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """setting, category, thr_idx, ap, recall, n_gt. ``truth``: unit, category, gt, crowd, area; ``detections``: unit,
    category, det, score, area; ``pairs``: unit, category, det, gt, iou > 0.

    The best ``most`` detections of a (unit, category) take part. Crowd truth and truth outside of the area range is
    not to be found: it gives no recall, and unmatched detections that overlap it at the threshold don't count;
    neither do unmatched ones outside of the range themselves. Categories without truth have ap and recall null.
    Null and NaN scores take no part; equal scores go by unit, then det.
    """
    keys, cell = ["setting", unit, "category"], ["setting", "category"]
    names = F.array(*(F.lit(s.name) for s in settings))
    within = lambda s: F.lit(True) if s.area is None else F.coalesce((F.col("area") >= s.area[0]) & (F.col("area") <= s.area[1]), F.lit(False))
    each = F.inline(F.array(*(F.struct(F.lit(s.name).alias("setting"), (F.col("crowd") | ~within(s)).alias("ignored")) for s in settings)))
    truth = truth.select(unit, "category", "gt", each)
    by_score = Window.partitionBy(unit, "category").orderBy(F.col("score").desc(), "det")
    best = detections.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("_k", F.row_number().over(by_score)).where(F.col("_k") <= max(s.most for s in settings))
    each = F.inline(F.array(*(F.struct(F.lit(s.name).alias("setting"), F.lit(s.most).alias("_most"), within(s).alias("inside")) for s in settings)))
    best = best.select(unit, "category", "det", "score", "_k", each).where("_k <= _most").drop("_k", "_most")
    order = [F.col("score").desc(), F.col(unit), F.col("det")]
    best = best.repartitionByRange(*cell, *order).withColumn("part", F.spark_partition_id())  # equal scores too are parted
    best = materialize(best, "detections")
    near = pairs.select(unit, "category", "det", "gt", "iou", F.explode(names).alias("setting")).where(F.col("iou") >= min(thresholds))
    near = near.join(best.drop("part"), [*keys, "det"]).join(truth.select(*keys, "gt", "ignored"), [*keys, "gt"])
    near = materialize(near, "near")
    hits = greedy_by_score(near.where("NOT ignored").select(*keys, "det", "score", "gt", "iou"), keys, thresholds).select(*keys, "det", "thr_idx")
    at = F.posexplode(F.array(*(F.lit(t) for t in thresholds))).alias("thr_idx", "thr")
    excused = near.where("ignored").select(*keys, "det", "iou", at).where("iou >= thr").select(*keys, "det", "thr_idx").distinct()
    hits = materialize(hits.withColumn("hit", F.lit(True)).join(excused.withColumn("excused", F.lit(True)), [*keys, "det", "thr_idx"], "full"), "hits")
    # prefix counts: detections inside the area, whatever the threshold; then what single thresholds change
    base = _prefix(best.withColumn("one", F.col("inside").cast("long")), cell, order, "one", "n_before")
    changed = base.join(hits, [*keys, "det"])
    # a hit outside of the area counts after all; an excused detection inside of it does not
    delta = F.when(F.col("hit") & ~F.col("inside"), 1).when(F.col("hit").isNull() & F.col("excused") & F.col("inside"), -1).otherwise(0).cast("long")
    counted = _prefix(changed.withColumns({"delta": delta, "tp": F.coalesce(F.col("hit"), F.lit(False)).cast("long")}), [*cell, "thr_idx"], order, "delta", "changed")
    counted = _prefix(counted, [*cell, "thr_idx"], order, "tp", "tp_before")
    n_gt = truth.groupBy(*cell).agg(F.count_if(~F.col("ignored")).alias("n_gt"))
    true = counted.where("hit").join(n_gt.where("n_gt > 0"), cell)
    precision, recall = F.col("tp_before") / (F.col("n_before") + F.col("changed")), F.col("tp_before") / F.col("n_gt")
    level = F.floor(recall * 100 + 1e-9).cast("int")
    cells = true.groupBy(*cell, "thr_idx", level.alias("level")).agg(F.max(precision).alias("p"), F.max(recall).alias("r"))
    best_later = F.max("p").over(Window.partitionBy(*cell, "thr_idx").orderBy(F.col("level").desc()))
    width = F.col("level") - F.coalesce(F.lag("level").over(Window.partitionBy(*cell, "thr_idx").orderBy("level")), F.lit(-1))
    found = cells.withColumns({"e": best_later, "w": width}).groupBy(*cell, "thr_idx").agg((F.sum(F.col("e") * F.col("w")) / 101).alias("ap"), F.max("r").alias("recall"))
    every = n_gt.withColumn("thr_idx", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))))
    out = every.join(found, [*cell, "thr_idx"], "left")
    zero = lambda c: F.when(F.col("n_gt") > 0, F.coalesce(c, F.lit(0.0)))
    return out.select("setting", "category", "thr_idx", zero("ap").alias("ap"), zero("recall").alias("recall"), "n_gt")


def _prefix(df: DataFrame, groups: list[str], order: list, value: str, name: str) -> DataFrame:
    """Inclusive prefix sums of ``value`` in ``order`` per group, in two steps over ``part``."""
    within = Window.partitionBy(*groups, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*groups, "part").agg(F.sum(value).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    own = df.withColumn(name, F.sum(value).over(within)).join(totals.withColumn("_b", before).drop("_t"), [*groups, "part"])
    return own.withColumn(name, F.col(name) + F.col("_b")).drop("_b")


def summary(per_category: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Means over the categories that have truth: mAP over all thresholds, at 0.50 and 0.75, mean recall; -1 if
    nothing is defined."""
    at = lambda i, c: F.avg(F.when(F.col("thr_idx") == i, F.col(c)))
    m = per_category.agg(F.avg("ap").alias("AP"), at(0, "ap").alias("AP_50"), at(5, "ap").alias("AP_75"), F.avg("recall").alias("AR"))
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(c, F.lit(-1.0)).alias("value")) for c in ("AP", "AP_50", "AP_75", "AR")))
    return m.select(F.inline(cells))


AREAS = {"small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}  #: fixed ranges, in pixels


def standard_settings(areas: dict[str, tuple[float, float]] = AREAS, limits: tuple[int, ...] = (1, 10, 100)) -> list[Setting]:
    """All areas at the largest limit, then each area range there, and the smaller limits for all areas."""
    top = max(limits)
    return [Setting("all", None, top), *(Setting(name, area, top) for name, area in areas.items()), *(Setting(f"all@{m}", None, m) for m in sorted(limits)[:-1])]


def standard_summary(per_category: DataFrame, settings: list[Setting]) -> DataFrame:
    """metric, value of the benchmark's summary: AP, AP_50, AP_75, AP per area range, AR per limit and per range; the mean
    over all categories with truth, -1 if there is none. ``per_category`` as of ``standard_settings``."""
    at = lambda i, c: F.avg(F.when(F.col("thr_idx") == i, F.col(c)))
    means = per_category.groupBy("setting").agg(F.avg("ap").alias("ap"), at(0, "ap").alias("ap50"), at(5, "ap").alias("ap75"), F.avg("recall").alias("ar"))
    names = [(s.name, s.area is None, s.most) for s in settings]
    rows = []
    for name, whole, most in names:
        if name == "all":
            rows += [(name, "AP", "ap"), (name, "AP_50", "ap50"), (name, "AP_75", "ap75"), (name, f"AR_{most}", "ar")]
        elif whole:
            rows.append((name, f"AR_{most}", "ar"))
        else:
            rows += [(name, f"AP_{name}", "ap"), (name, f"AR_{name}", "ar")]
    cells = F.array(*(F.when(F.col("setting") == n, F.struct(F.lit(m).alias("metric"), F.coalesce(c, F.lit(-1.0)).alias("value"))) for n, m, c in rows))
    found = means.select(F.explode(cells).alias("c")).where("c IS NOT NULL").select("c.metric", "c.value")
    every = per_category.sparkSession.createDataFrame([(m,) for _, m, _ in rows], "metric STRING")
    return every.join(F.broadcast(found), "metric", "left").select("metric", F.coalesce("value", F.lit(-1.0)).alias("value"))
