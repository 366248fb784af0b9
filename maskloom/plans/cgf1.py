"""Image and phrase level F1 with a correlation factor, from additive counters per unit.

``per_unit`` makes one row of counters per (unit, threshold list), ``combine`` sums them (any grouping, one
partial and final aggregation), ``finalize`` derives the ratios. The small constants are part of the metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators.assign import assign

THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]
BOX_EPS, IMAGE_EPS = 1e-4, 1e-6


def per_unit(units: DataFrame, truth: DataFrame, detections: DataFrame, pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counters of each unit: n_gt, n_dt, tp[10], f1[10] (null for true negatives), sum_iou.

    ``units``: keys of all units to evaluate; ``truth``: keys, gt, crowd; ``detections``: keys, det, score;
    ``pairs``: keys, det, gt, iou > 0, score, crowd. Crowd truth is left out, as are detections under the
    threshold; both before matching. Null and NaN scores are under every threshold.
    """
    strong = F.coalesce((F.col("score") >= threshold) & ~F.isnan("score"), F.lit(False))
    n_gt = truth.where(~F.col("crowd")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    n_dt = detections.where(strong).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dt"))
    candidates = pairs.where(strong & ~F.col("crowd")).select(*keys, F.col("det").alias("left"), F.col("gt").alias("right"), F.col("iou").alias("weight"))
    flipped = candidates.select(*keys, F.col("right").alias("left"), F.col("left").alias("right"), "weight")
    matched = assign(flipped, keys)
    hits = F.array(*(F.count_if(F.col("weight") >= t) for t in THRESHOLDS))
    tp = matched.groupBy(*keys).agg(hits.alias("tp"), F.sum("weight").alias("sum_iou"))
    joined = units.join(n_gt, keys, "left").join(n_dt, keys, "left").join(tp, keys, "left")
    zero = F.lit(0).cast("long")
    none = F.array(*[zero] * len(THRESHOLDS))
    out = joined.select(*units.columns, F.coalesce("n_gt", zero).alias("n_gt"), F.coalesce("n_dt", zero).alias("n_dt"), F.coalesce("tp", none).alias("tp"), F.coalesce("sum_iou", F.lit(0.0)).alias("sum_iou"))
    return out.withColumn("f1", F.when((F.col("n_gt") > 0) | (F.col("n_dt") > 0), F.transform("tp", lambda t: unit_f1(t, F.col("n_dt"), F.col("n_gt")))))


def unit_f1(tp: Column, n_dt: Column, n_gt: Column) -> Column:
    p, r = tp / (n_dt + BOX_EPS), tp / (n_gt + BOX_EPS)
    return 2 * p * r / (p + r + BOX_EPS)


def best_annotator(units: DataFrame, keys: list[str], annotator: str) -> DataFrame:
    """Of several annotators' records of a unit, the best in their order: a higher mean F1 replaces the record
    so far, a record without F1 (nothing annotated, nothing detected) counts as perfect."""
    mean = F.aggregate("f1", F.lit(0.0), lambda s, v: s + v) / len(THRESHOLDS)
    record = F.struct(F.col(annotator).alias("at"), mean.alias("mean"), "n_gt", "n_dt", "tp", "sum_iou", "f1")
    lists = units.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("r"))  # a few annotators a unit

    def better(best: Column, new: Column) -> Column:
        return F.when(new["mean"].isNull() | (best["mean"].isNotNull() & (new["mean"] > best["mean"])), new).otherwise(best)

    best = F.aggregate(F.slice("r", F.lit(2), F.size("r")), F.col("r")[0], better)
    return lists.select(*keys, best.alias("b")).select(*keys, F.col("b.at").alias(annotator), "b.n_gt", "b.n_dt", "b.tp", "b.sum_iou", "b.f1")


def combine(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the units' counters; one row, or one per group."""
    box, both = F.col("f1").isNotNull(), (F.col("n_gt") > 0) & (F.col("n_dt") > 0)
    sums = [
        F.count_if((F.col("n_gt") > 0) & (F.col("n_dt") > 0)).alias("il_tp"), F.count_if((F.col("n_gt") == 0) & (F.col("n_dt") > 0)).alias("il_fp"),
        F.count_if((F.col("n_gt") == 0) & (F.col("n_dt") == 0)).alias("il_tn"), F.count_if((F.col("n_gt") > 0) & (F.col("n_dt") == 0)).alias("il_fn"),
        F.sum("n_gt").alias("n_gt"), F.sum("n_dt").alias("n_dt"), F.sum(F.when(F.col("n_gt") > 0, F.col("n_dt")).otherwise(0)).alias("n_dt_positive"),
        F.count_if(both).alias("n_both"), F.sum(F.when(both, F.least("n_gt", "n_dt"))).alias("n_matched"), F.sum("sum_iou").alias("sum_iou"),
        *(F.sum(F.col("tp")[i]).alias(f"tp_{i}") for i in range(10)), *(F.sum(F.when(both, F.col("f1")[i])).alias(f"f1_{i}") for i in range(10)),
        *(F.count_if(box & (F.col("tp")[i] == F.col("n_gt")) & (F.col("tp")[i] == F.col("n_dt"))).alias(f"perfect_{i}") for i in range(10)),
    ]
    return units.groupBy(*(by or [])).agg(*sums)


def mcc() -> Column:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("il_tp", "il_fp", "il_tn", "il_fn"))
    return (tp * tn - fp * fn) / (F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn) + IMAGE_EPS)


def finalize(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Named metrics in long form: by, metric, threshold (null: mean over all, or image level), value.

    Ratios without a denominator are null. ``cgF1`` is the positive micro F1 times the correlation,
    ``cgF1_macro`` the macro F1 times it.
    """
    by = by or []
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("il_tp", "il_fp", "il_tn", "il_fn"))
    il = sums.select(*by, "sum_iou", "n_matched", (tp / (tp + fp + IMAGE_EPS)).alias("p"), (tp / (tp + fn + IMAGE_EPS)).alias("r"), (fp / (fp + tn + IMAGE_EPS)).alias("fpr"), mcc().alias("mcc"))
    p, r = F.col("p"), F.col("r")
    cell = lambda name, v: F.struct(F.lit(name).alias("metric"), F.lit(None).cast("double").alias("threshold"), v.alias("value"))
    image = il.select(*by, F.inline(F.array(
        cell("IL_precision", p), cell("IL_recall", r), cell("IL_F1", 2 * p * r / (p + r + IMAGE_EPS)), cell("IL_FPR", F.col("fpr")), cell("IL_MCC", F.col("mcc")),
        cell("J", F.try_divide(F.col("sum_iou"), F.col("n_matched").cast("double"))),
    )))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"f1_{i}").alias("f1"), F.col(f"perfect_{i}").alias("perfect")) for i, t in enumerate(THRESHOLDS)))
    each = sums.select(*by, "n_gt", "n_dt", "n_dt_positive", "n_both", mcc().alias("mcc"), (tp + fp + fn).alias("n_units"), F.inline(rows))
    each = each.withColumns({"precision": F.col("tp") / (F.col("n_dt") + BOX_EPS), "recall": F.col("tp") / (F.col("n_gt") + BOX_EPS), "positive_micro_precision": F.col("tp") / (F.col("n_dt_positive") + BOX_EPS)})
    p, r, pp = F.col("precision"), F.col("recall"), F.col("positive_micro_precision")
    each = each.withColumns({"F1": 2 * p * r / (p + r + BOX_EPS), "positive_micro_F1": 2 * pp * r / (pp + r + BOX_EPS), "positive_macro_F1": F.try_divide(F.col("f1"), F.col("n_both").cast("double")), "perfect": F.try_divide(F.col("perfect").cast("double"), F.col("n_units"))})
    each = each.withColumns({"cgF1": F.col("positive_micro_F1") * F.col("mcc"), "cgF1_macro": F.col("positive_macro_F1") * F.col("mcc")})
    names = ["precision", "recall", "F1", "positive_micro_precision", "positive_micro_F1", "positive_macro_F1", "cgF1", "cgF1_macro", "perfect"]
    long = each.unpivot([*by, "threshold"], names, "metric", "value")
    mean = long.groupBy(*by, "metric").agg(F.avg("value").alias("value")).select(*by, "metric", F.lit(None).cast("double").alias("threshold"), "value")
    return image.unionByName(mean).unionByName(long.where(F.col("threshold").isin(THRESHOLDS[0], THRESHOLDS[5])).select(*by, "metric", "threshold", "value"))


HEADLINE = ["cgF1", "IL_MCC", "positive_micro_F1"]


def headline(final: DataFrame, subset: str) -> DataFrame:
    """The three numbers of each subset, means over the thresholds, and their unweighted mean (subset null)."""
    whole = final.where("threshold IS NULL").groupBy(subset).pivot("metric", HEADLINE).agg(F.max("value"))
    mean = whole.agg(*(F.avg(m).alias(m) for m in HEADLINE)).select(F.lit(None).cast(final.schema[subset].dataType).alias(subset), *HEADLINE)
    return whole.unionByName(mean).select(subset, *(F.round(m, 6).alias(m) for m in HEADLINE))
