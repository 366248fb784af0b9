"""Tracking-every-thing accuracy: localisation, association and classification apart.

Matching over all classes comes first; a tracker row matched there to another class is no candidate of a
class. Then per (sequence, class): tracks that overlap the class' truth anywhere take part with all their
rows, are aligned and matched per frame, and are counted at 20 thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.assign import assign
from maskloom.operators.overlaps import overlapping
from maskloom.plans.hota import EPS, alignment
from maskloom.shared import materialize

ALPHAS = [0.05 * i for i in range(20)]
CLS_FROM = 10  #: classification counts from this threshold (0.5) on
OVERLAP = 0.5


def _matches(truth: DataFrame, tracker: DataFrame, sims: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Optimal matches per frame by alignment times similarity: keys, t, gt, tr, sim."""
    tracks = alignment(truth, tracker, sims, keys).select(*keys, "gt", "tr", "align")
    w = sims.join(tracks, [*keys, "gt", "tr"]).select(*keys, "t", F.col("gt").alias("left"), F.col("tr").alias("right"), (F.col("align") * F.col("sim")).alias("weight"), "sim")
    return assign(w, [*keys, "t"]).select(*keys, "t", F.col("left").alias("gt"), F.col("right").alias("tr"), "sim")


def per_sequence(truth: DataFrame, tracker: DataFrame, exhaustive: bool = True) -> DataFrame:
    """Counters per (seq, cls, alpha_idx). ``truth`` and ``tracker``: seq, t, id, cls, box, and non-null keys.

    Defined cases: classes without truth have counters only for what the tracker wrongly calls so (if
    ``exhaustive``); a class that no tracker row overlaps has all its truth missed.
    """
    unit = ["seq", "cls"]
    g = truth.select("seq", "t", F.col("id").alias("gt"), F.col("cls").alias("gcls"), F.col("box").alias("gb"))
    r = tracker.select("seq", "t", F.col("id").alias("tr"), F.col("cls").alias("rcls"), F.col("box").alias("rb"))
    sims = overlapping(g, r, ["seq", "t"], "gb", "rb", "sim").select("seq", "t", "gt", "tr", "gcls", "rcls", "sim")
    sims = materialize(sims, "similarities")
    near = sims.where(F.col("sim") >= OVERLAP)
    used = near.select("seq", "tr").distinct()
    over_all = _matches(truth, tracker.join(used.withColumnRenamed("tr", "id"), ["seq", "id"], "left_semi"), sims.join(used, ["seq", "tr"], "left_semi").select("seq", "t", "gt", "tr", "sim"), ("seq",))
    taken = over_all.where(F.col("sim") >= OVERLAP - EPS).join(sims.select("seq", "t", "gt", F.col("gcls").alias("taken")).distinct(), ["seq", "t", "gt"]).select("seq", "t", "tr", "taken")
    overlap = near.select("seq", "t", "tr", F.col("gcls").alias("cls")).distinct().join(taken, ["seq", "t", "tr"], "left").where("taken IS NULL OR taken = cls").select("seq", "t", "tr", "cls")
    overlap = materialize(overlap, "overlaps")
    part = overlap.select("seq", "tr", "cls").distinct()
    own_tracker = tracker.select("seq", "t", F.col("id").alias("tr")).join(part, ["seq", "tr"]).select(*unit, "t", F.col("tr").alias("id"))
    own_truth = truth.select(*unit, "t", "id")
    own_sims = sims.withColumn("cls", F.col("gcls")).join(part, ["seq", "tr", "cls"], "left_semi")
    own_sims = materialize(own_sims.select(*unit, "t", "gt", "tr", "rcls", "sim"), "class-similarities")
    matched = _matches(own_truth, own_tracker, own_sims.select(*unit, "t", "gt", "tr", "sim"), ("seq", "cls")).join(own_sims.select(*unit, "t", "gt", "tr", "rcls"), [*unit, "t", "gt", "tr"])
    matched = materialize(matched, "matched")
    at = F.posexplode(F.array(*map(F.lit, ALPHAS))).alias("alpha_idx", "alpha")
    hits = matched.select("*", at).where(F.col("sim") >= F.col("alpha") - EPS)
    is_overlap = overlap.select(*unit, "t", "tr", F.lit(1).alias("o"))
    cls_at, right = F.col("alpha_idx") >= CLS_FROM, F.col("rcls") == F.col("cls")
    per = hits.join(is_overlap, [*unit, "t", "tr"], "left").groupBy(*unit, "alpha_idx").agg(
        F.count(F.lit(1)).alias("loc_tp"), F.count("o").alias("n_overlap_matched"), F.count_if(cls_at & right).alias("cls_tp"), F.count_if(cls_at & ~right).alias("cls_fn")
    )
    tracks = hits.groupBy(*unit, "alpha_idx", "gt", "tr").agg(F.count(F.lit(1)).alias("m"))
    n_gt = own_truth.groupBy(*unit, F.col("id").alias("gt")).agg(F.count(F.lit(1)).alias("n_gt"))
    n_tr = own_tracker.groupBy(*unit, F.col("id").alias("tr")).agg(F.count(F.lit(1)).alias("n_tr"))
    m, one = F.col("m"), F.lit(1)
    ass = tracks.join(n_gt, [*unit, "gt"]).join(n_tr, [*unit, "tr"]).groupBy(*unit, "alpha_idx").agg(
        F.sum(m * m / F.greatest(one, F.col("n_gt") + F.col("n_tr") - m)).alias("a"), F.sum(m * m / F.greatest(one, F.col("n_gt"))).alias("ar"), F.sum(m * m / F.greatest(one, F.col("n_tr"))).alias("ap")
    )
    wrong = hits.where(cls_at & ~right).groupBy("seq", F.col("rcls").alias("cls"), "alpha_idx").agg(F.count(F.lit(1)).alias("wrong"))
    counts = truth.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_truth"))
    overlaps = is_overlap.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_overlap"))
    units = counts.join(overlaps, unit, "full")
    if exhaustive:
        called = tracker.select("seq", "t", F.col("id").alias("tr"), "cls").join(overlap, ["seq", "t", "tr", "cls"], "left_anti")
        units = units.join(called.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_called")), unit, "full")
    else:
        units = units.withColumn("n_called", F.lit(0))
    every = units.withColumn("alpha_idx", F.explode(F.sequence(F.lit(0), F.lit(len(ALPHAS) - 1))))
    for other in (per, ass, wrong):
        every = every.join(other, [*unit, "alpha_idx"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    tp = zero("loc_tp")
    share = lambda c: F.coalesce(F.col(c) / F.greatest(one, tp), F.lit(0.0))
    return every.select(
        *unit, "alpha_idx", tp.alias("loc_tp"), (zero("n_truth") - tp).alias("loc_fn"), (zero("n_overlap") - zero("n_overlap_matched")).alias("loc_fp"),
        zero("cls_tp").alias("cls_tp"), zero("cls_fn").alias("cls_fn"), F.when(cls_at, zero("wrong") + zero("n_called")).otherwise(F.lit(0).cast("long")).alias("cls_fp"), share("a").alias("ass"), share("ar").alias("ass_re"), share("ap").alias("ass_pr"),
    )


def combine(units: DataFrame, by: list[str]) -> DataFrame:
    """Counters summed over the rest, association weighted by localised rows."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("loc_tp")) / F.greatest(F.lit(1), F.sum("loc_tp"))).alias(c)
    sums = [F.sum(c).alias(c) for c in ("loc_tp", "loc_fn", "loc_fp", "cls_tp", "cls_fn", "cls_fp")]
    return units.groupBy(*by, "alpha_idx").agg(*sums, weighted("ass"), weighted("ass_re"), weighted("ass_pr"))


def finalize(counters: DataFrame, by: list[str]) -> DataFrame:
    """TETA, LocA, AssocA, ClsA and their recalls and precisions, in percent, as means over the thresholds."""
    one = F.lit(1)
    ratio = lambda p, *rest: F.col(p) / F.greatest(one, sum((F.col(r) for r in rest), F.col(p)))
    cls = lambda p, *rest: F.when(F.col("alpha_idx") >= CLS_FROM, ratio(p, *rest))
    rows = counters.withColumns({
        "LocA": ratio("loc_tp", "loc_fn", "loc_fp"), "LocRe": ratio("loc_tp", "loc_fn"), "LocPr": ratio("loc_tp", "loc_fp"), "AssocA": F.col("ass"), "AssocRe": F.col("ass_re"), "AssocPr": F.col("ass_pr"),
        "ClsA": cls("cls_tp", "cls_fn", "cls_fp"), "ClsRe": cls("cls_tp", "cls_fn"), "ClsPr": cls("cls_tp", "cls_fp"),
    })
    names = ["LocA", "LocRe", "LocPr", "AssocA", "AssocRe", "AssocPr", "ClsA", "ClsRe", "ClsPr"]
    out = rows.groupBy(*by).agg(*((F.avg(n) * 100).alias(n) for n in names))
    return out.withColumn("TETA", (F.col("LocA") + F.col("AssocA") + F.col("ClsA")) / 3)


def class_averaged(per_class: DataFrame) -> DataFrame:
    return per_class.agg(*(F.avg(c).alias(c) for c in per_class.columns if c not in ("cls", "seq")))
