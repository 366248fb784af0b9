"""Higher-order tracking accuracy, from similarities per frame.

Steps are joins and aggregations over the table of overlapping (sequence, frame, truth, tracker) pairs; only
frames in which the best partners collide reach the assignment in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.functions import boxes as B
from maskloom.operators.assign import assign
from maskloom.operators.overlaps import overlapping
from maskloom.shared import materialize

ALPHAS = [0.05 * i for i in range(1, 20)]
EPS = 2.220446049250313e-16
COUNTERS = ["tp", "fn", "fp", "loc_sum", "ass", "ass_re", "ass_pr"]


def similarities(truth: DataFrame, tracker: DataFrame) -> DataFrame:
    """seq, t, gt, tr, sim > 0 of boxes (xywh) in the same frame. Both: seq, t, id, box."""
    g = truth.select("seq", "t", F.col("id").alias("gt"), F.col("box").alias("gb"))
    r = tracker.select("seq", "t", F.col("id").alias("tr"), F.col("box").alias("rb"))
    return overlapping(g, r, ["seq", "t"], "gb", "rb", "sim").select("seq", "t", "gt", "tr", "sim")


def alignment(truth: DataFrame, tracker: DataFrame, sims: DataFrame, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """keys, gt, tr, align: potential matches of two tracks over all frames, by the frames either has."""
    rows, columns = Window.partitionBy(*keys, "t", "gt"), Window.partitionBy(*keys, "t", "tr")
    share = sims.withColumn("u", F.sum("sim").over(rows) + F.sum("sim").over(columns) - F.col("sim"))
    potential = share.groupBy(*keys, "gt", "tr").agg(F.sum(F.when(F.col("u") > EPS, F.col("sim") / F.col("u")).otherwise(0.0)).alias("p"))
    n_gt = truth.groupBy(*keys, F.col("id").alias("gt")).agg(F.count(F.lit(1)).alias("n_gt"))
    n_tr = tracker.groupBy(*keys, F.col("id").alias("tr")).agg(F.count(F.lit(1)).alias("n_tr"))
    j = potential.join(n_gt, [*keys, "gt"]).join(n_tr, [*keys, "tr"])
    return j.withColumn("align", F.col("p") / (F.col("n_gt") + F.col("n_tr") - F.col("p")))


def per_sequence(truth: DataFrame, tracker: DataFrame, sims: DataFrame | None = None) -> DataFrame:
    """Counters per sequence and alpha. ``truth`` and ``tracker``: seq, t, id, box; ids once a frame.

    A sequence without tracker rows has all truth missed, one without truth all tracker rows wrong, both with
    zero association and no matches. Frames of null boxes should be left out before.
    """
    sims = materialize(similarities(truth, tracker) if sims is None else sims, "similarities")
    tracks = materialize(alignment(truth, tracker, sims), "alignment")
    weighted = sims.join(tracks.select("seq", "gt", "tr", "align"), ["seq", "gt", "tr"]).select("seq", "t", F.col("gt").alias("left"), F.col("tr").alias("right"), (F.col("align") * F.col("sim")).alias("weight"), "sim")
    matched = materialize(assign(weighted, ["seq", "t"]).select("seq", F.col("left").alias("gt"), F.col("right").alias("tr"), "sim"), "matched")
    at = F.posexplode(F.array(*map(F.lit, ALPHAS))).alias("alpha_idx", "alpha")
    hits = matched.select("*", at).where(F.col("sim") >= F.col("alpha") - EPS)
    per_track = hits.groupBy("seq", "alpha_idx", "gt", "tr").agg(F.count(F.lit(1)).alias("m"), F.sum("sim").alias("s"))
    per_track = per_track.join(tracks.select("seq", "gt", "tr", "n_gt", "n_tr"), ["seq", "gt", "tr"])
    m, one = F.col("m"), F.lit(1)
    sums = per_track.groupBy("seq", "alpha_idx").agg(
        F.sum("m").alias("tp"), F.sum("s").alias("loc_sum"), F.sum(m * m / F.greatest(one, F.col("n_gt") + F.col("n_tr") - m)).alias("a"),
        F.sum(m * m / F.greatest(one, F.col("n_gt"))).alias("ar"), F.sum(m * m / F.greatest(one, F.col("n_tr"))).alias("ap"),
    )
    n = truth.groupBy("seq").agg(F.count(F.lit(1)).alias("n_truth")).join(tracker.groupBy("seq").agg(F.count(F.lit(1)).alias("n_tracker")), "seq", "full")
    every = n.withColumn("alpha_idx", F.explode(F.sequence(F.lit(0), F.lit(len(ALPHAS) - 1)))).join(sums, ["seq", "alpha_idx"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tp = zero("tp")
    ratio = lambda c: F.coalesce(F.col(c) / F.greatest(one, tp), F.lit(0.0))
    return every.select("seq", "alpha_idx", tp.alias("tp"), (zero("n_truth") - tp).alias("fn"), (zero("n_tracker") - tp).alias("fp"), F.coalesce("loc_sum", F.lit(0.0)).alias("loc_sum"), ratio("a").alias("ass"), ratio("ar").alias("ass_re"), ratio("ap").alias("ass_pr"))


def combine(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters summed, association weighted by true positives."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("tp")) / F.greatest(F.lit(1), F.sum("tp"))).alias(c)
    return units.groupBy(*(by or []), "alpha_idx").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), F.sum("loc_sum").alias("loc_sum"), weighted("ass"), weighted("ass_re"), weighted("ass_pr"))


def finalize(counters: DataFrame) -> DataFrame:
    """HOTA, DetA, AssA, DetRe, DetPr, AssRe, AssPr, LocA, OWTA beside the keys and counters."""
    tp, fn, fp, one = F.col("tp"), F.col("fn"), F.col("fp"), F.lit(1)
    det_re, det_pr, det_a = tp / F.greatest(one, tp + fn), tp / F.greatest(one, tp + fp), tp / F.greatest(one, tp + fn + fp)
    loc = F.greatest(F.lit(1e-10), F.col("loc_sum")) / F.greatest(F.lit(1e-10), tp)
    return counters.withColumns({"DetRe": det_re, "DetPr": det_pr, "DetA": det_a, "AssA": F.col("ass"), "AssRe": F.col("ass_re"), "AssPr": F.col("ass_pr"), "LocA": loc, "HOTA": F.sqrt(det_a * F.col("ass")), "OWTA": F.sqrt(det_re * F.col("ass"))})


METRICS = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA", "OWTA"]


def mean_over_alphas(final: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of each metric over the thresholds, with HOTA(0), LocA(0) and their product."""
    first = lambda c: F.max(F.when(F.col("alpha_idx") == 0, F.col(c)))
    out = final.groupBy(*(by or [])).agg(*(F.avg(m).alias(m) for m in METRICS), first("HOTA").alias("HOTA_0"), first("LocA").alias("LocA_0"))
    return out.withColumn("HOTALocA_0", F.col("HOTA_0") * F.col("LocA_0"))


def phrase_frames(tracks: DataFrame, threshold: float | None = None) -> DataFrame:
    """Tracks as frames for phrase evaluation: the sequence is the (video, category) pair as text; rows of a
    score over the threshold; frames of no area or zero box are absent. A track without any areas has those of
    its boxes. tracks: video_id, category_id, id, bboxes, areas[, score]."""
    own = tracks if threshold is None else tracks.where(F.col("score") > threshold)
    own = own.withColumn("areas", F.coalesce("areas", F.transform("bboxes", B.area_xywh)))
    f = own.select(F.concat_ws(":", F.col("video_id").cast("string"), F.col("category_id").cast("string")).alias("seq"), "id", F.posexplode(F.arrays_zip("bboxes", "areas")).alias("t", "z"))
    present = (F.coalesce(F.col("z.areas"), F.lit(0.0)) > 0) & ~B.is_zero(F.col("z.bboxes"))
    return f.where(present).select("seq", "t", "id", F.col("z.bboxes").alias("box"))


def f_column(name: str) -> Column:
    return F.round(name, 6).alias(name)
