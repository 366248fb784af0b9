import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.operators.assign import hungarian
from maskloom.plans import ap, cgf1, hota, teta

rng = np.random.default_rng(11)


def iou(a, b):
    w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    u = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / u if u > 0 else 0.0


def image_set(n=40):
    truth, dets, k = [], [], 0
    for i in range(n):
        for _ in range(rng.integers(0, 4)):
            b = [float(v) for v in (*rng.integers(0, 30, 2), *rng.integers(4, 12, 2))]
            truth.append((i, k, bool(rng.random() < 0.1), b))
            for _ in range(rng.integers(0, 3)):
                dets.append((i, 1000 + len(dets), float(rng.choice([0.3, 0.5, 0.8, rng.random()])), [b[0] + rng.integers(-2, 3), b[1] + rng.integers(-2, 3), b[2], b[3]]))
            k += 1
        if rng.random() < 0.3:
            dets.append((i, 1000 + len(dets), 0.9, [50.0, 50.0, 5.0, 5.0]))
    return truth, [(i, d, s, [float(v) for v in b]) for i, d, s, b in dets]


def frames(spark, truth, dets):
    t = spark.createDataFrame(truth, "image_id INT, gt BIGINT, crowd BOOLEAN, gb ARRAY<DOUBLE>")
    d = spark.createDataFrame(dets, "image_id INT, det BIGINT, score DOUBLE, db ARRAY<DOUBLE>")
    p = t.join(d, "image_id").withColumn("iou", B.iou_xywh(F.col("db"), F.col("gb"))).where("iou > 0")
    return t, d, p


def test_cgf1_by_hand(spark):
    truth, dets = image_set()
    t, d, p = frames(spark, truth, dets)
    units = spark.range(40).select(F.col("id").cast("int").alias("image_id"))
    got = {(r.metric, r.threshold): r.value for r in cgf1.finalize(cgf1.combine(cgf1.per_unit(units, t, d, p, ["image_id"]))).collect()}
    tp = np.zeros(10)
    flags, n_gt, n_dt, pos, f1 = np.zeros(4), 0, 0, 0, []
    for i in range(40):
        g = [b for j, _, c, b in truth if j == i and not c]
        e = [b for j, _, s, b in dets if j == i and s >= 0.5]
        w = np.array([[iou(a, b) for b in e] for a in g]).reshape(len(g), len(e))
        own = np.array([sum(w[m] >= t for m in hungarian(w)) for t in cgf1.THRESHOLDS], float)
        flags += [bool(g) and bool(e), not g and bool(e), not g and not e, bool(g) and not e]
        tp, n_gt, n_dt, pos = tp + own, n_gt + len(g), n_dt + len(e), pos + len(e) * bool(g)
        if g and e:
            pr, re = own / (len(e) + 1e-4), own / (len(g) + 1e-4)
            f1.append(2 * pr * re / (pr + re + 1e-4))
    il_tp, il_fp, il_tn, il_fn = flags
    mcc = (il_tp * il_tn - il_fp * il_fn) / (np.sqrt((il_tp + il_fp) * (il_tp + il_fn) * (il_tn + il_fp) * (il_tn + il_fn)) + 1e-6)
    pp, re = tp / (pos + 1e-4), tp / (n_gt + 1e-4)
    pm = 2 * pp * re / (pp + re + 1e-4)
    assert got["IL_MCC", None] == pytest.approx(mcc)
    assert got["cgF1", None] == pytest.approx((pm * mcc).mean()) and got["cgF1", 0.75] == pytest.approx((pm * mcc)[5])
    assert got["positive_macro_F1", None] == pytest.approx(np.mean(f1)) and got["precision", 0.5] == pytest.approx(tp[0] / (n_dt + 1e-4))


def test_golden_counters(spark):
    """Published counters: TP, FP, FN at 0.5 of 14, 6, 19 and image flags of 6, 0, 1, 1."""
    n = [*[(0, 0)] * 1, *[(1, 0)] * 1, *[(5, 3)] * 5, (7, 5)]
    assert sum(g for g, _ in n) == 33 and sum(d for _, d in n) == 20
    tp = [0, 0, 2, 2, 2, 2, 2, 4]
    rows = [(i, g, d, [k] * 10, 0.0, None if g == d == 0 else [0.0] * 10) for i, ((g, d), k) in enumerate(zip(n, tp, strict=True))]
    units = spark.createDataFrame(rows, "u INT, n_gt BIGINT, n_dt BIGINT, tp ARRAY<BIGINT>, sum_iou DOUBLE, f1 ARRAY<DOUBLE>")
    got = {(r.metric, r.threshold): r.value for r in cgf1.finalize(cgf1.combine(units)).collect()}
    assert got["precision", 0.5] == pytest.approx(0.6999965) and got["recall", 0.5] == pytest.approx(0.4242411) and got["F1", 0.5] == pytest.approx(0.5282529, abs=1e-6)
    assert got["IL_MCC", None] == pytest.approx(0.6546535992794136)


def test_best_annotator(spark):
    rec = lambda u, a, f: (u, a, 1, 1, [0] * 10, 0.0, f)
    rows = [rec(1, 0, [0.5] * 10), rec(1, 1, [0.5] * 10), rec(1, 2, [0.6] * 10), rec(2, 0, [0.9] * 10), rec(2, 1, None), rec(2, 2, [1.0] * 10), rec(3, 0, [0.9] * 10), rec(3, 1, [0.1] * 10)]
    units = spark.createDataFrame(rows, "u INT, a INT, n_gt BIGINT, n_dt BIGINT, tp ARRAY<BIGINT>, sum_iou DOUBLE, f1 ARRAY<DOUBLE>")
    assert {r.u: r.a for r in cgf1.best_annotator(units, ["u"], "a").collect()} == {1: 2, 2: 1, 3: 0}


def brute_ap(truth, dets, t):
    order = sorted(dets, key=lambda d: (-d[2], d[0], d[1]))
    taken, hits = set(), []
    n_gt = sum(not c for _, _, c, _ in truth)
    for i, _, _, b in order:
        free = [(iou(b, g), -k) for j, k, c, g in truth if j == i and not c and k not in taken and iou(b, g) >= t]
        if free:
            taken.add(-max(free)[1])
            hits.append(1)
        elif not any(c and j == i and iou(b, g) >= t for j, _, c, g in truth):
            hits.append(0)
    tp = np.cumsum(hits)
    recall, precision = tp / n_gt, tp / np.arange(1, len(hits) + 1)
    at = [max([p for p, r, h in zip(precision, recall, hits, strict=True) if h and r >= g - 1e-12], default=0.0) for g in np.arange(101) / 100]
    return np.mean(at), recall.max()


def test_average_precision(spark):
    truth, dets = image_set(60)
    t, d, p = frames(spark, truth, dets)
    own = lambda df: df.withColumn("category", F.lit(0))
    got = ap.average_precision(own(t).withColumn("area", F.lit(0.5)), own(d).withColumn("area", F.lit(0.5)), own(p), "image_id", [0.5, 0.75]).collect()
    for r in got:
        want = brute_ap(truth, dets, [0.5, 0.75][r.thr_idx])
        assert (r.ap, r.recall) == pytest.approx(want)
    empty = ap.average_precision(own(t).withColumn("area", F.lit(0.5)), own(d).withColumn("area", F.lit(0.5)).limit(0), own(p).limit(0), "image_id", [0.5]).collect()
    assert [(r.ap, r.recall) for r in empty] == [(0.0, 0.0)]
    nothing = ap.summary(ap.average_precision(own(t).withColumn("area", F.lit(0.5)).limit(0), own(d).withColumn("area", F.lit(0.5)), own(p).limit(0), "image_id", [0.5]))
    assert {r.metric: r.value for r in nothing.collect()} == {"AP": -1, "AP_50": -1, "AP_75": -1, "AR": -1}


def tracks(seed):
    r = np.random.default_rng(seed)
    g, t = [], []
    for s in ("a", "b"):
        for k in range(3):
            x = r.integers(0, 30, 2)
            for f in range(8):
                if r.random() < 0.85:
                    box = [float(x[0] + f), float(x[1]), 10.0, 10.0]
                    g.append((s, f, k, "c" if k < 2 else "d", box))
                    if r.random() < 0.85:
                        t.append((s, f, k * 10 + (f > 4) * (k == 1), "c" if k != 1 else "d", [box[0] + r.integers(-2, 3), box[1] + r.integers(-2, 3), 10.0, 10.0]))
    return g, [(s, f, k, c, [float(v) for v in b]) for s, f, k, c, b in t]


SCHEMA = "seq STRING, t INT, id BIGINT, cls STRING, box ARRAY<DOUBLE>"


def brute_hota(g, t, alpha):
    gids, tids = sorted({r[2] for r in g}), sorted({r[2] for r in t})
    pot, gc, tc = np.zeros((len(gids), len(tids))), np.zeros(len(gids)), np.zeros(len(tids))
    sims = {}
    for f in range(8):
        a, b = [r for r in g if r[1] == f], [r for r in t if r[1] == f]
        s = np.array([[iou(x[4], y[4]) for y in b] for x in a]).reshape(len(a), len(b))
        ia, ib = [gids.index(r[2]) for r in a], [tids.index(r[2]) for r in b]
        den = s.sum(0, keepdims=True) + s.sum(1, keepdims=True) - s
        pot[np.ix_(ia, ib)] += np.divide(s, den, out=np.zeros_like(s), where=den > 1e-15)
        gc[ia] += 1
        tc[ib] += 1
        sims[f] = s, ia, ib
    al = pot / (gc[:, None] + tc[None] - pot)
    m, tp, loc = np.zeros_like(pot), 0, 0.0
    for s, ia, ib in sims.values():
        for i, j in hungarian(al[np.ix_(ia, ib)] * s):
            if s[i, j] >= alpha - 2e-16 and s[i, j] > 0:
                m[ia[i], ib[j]] += 1
                tp, loc = tp + 1, loc + s[i, j]
    ass = (m * m / np.maximum(1, gc[:, None] + tc[None] - m)).sum() / max(1, tp)
    return tp, len(g) - tp, len(t) - tp, loc, ass


def test_hota_by_hand(spark):
    g, t = tracks(2)
    out = hota.per_sequence(spark.createDataFrame(g, SCHEMA), spark.createDataFrame(t, SCHEMA)).collect()
    assert len(out) == 2 * 19
    for r in out:
        want = brute_hota([x for x in g if x[0] == r.seq], [x for x in t if x[0] == r.seq], hota.ALPHAS[r.alpha_idx])
        assert (r.tp, r.fn, r.fp, r.loc_sum, r.ass) == pytest.approx(want)


def test_perfect_and_empty_trackers(spark):
    g, _ = tracks(4)
    df = spark.createDataFrame(g, SCHEMA)
    m = hota.mean_over_alphas(hota.finalize(hota.combine(hota.per_sequence(df, df)))).first()
    assert m.HOTA == m.DetA == m.AssA == m.LocA == m.HOTA_0 == 1
    none = hota.finalize(hota.per_sequence(df, df.limit(0))).collect()
    assert all(r.tp == 0 and r.HOTA == 0 and r.LocA == 1 for r in none) and sum(r.fn for r in none) == 19 * len(g)
    final = teta.finalize(teta.combine(teta.per_sequence(df, df), ["cls"]), ["cls"]).collect()
    assert {r.cls for r in final} == {"c", "d"} and all(r.TETA == pytest.approx(100) for r in final)
    f = hota.finalize(hota.per_sequence(df, df.where("id <> 1"))).first()
    assert f.HOTA == pytest.approx(np.sqrt(f.DetA * f.AssA))


def test_teta_counts(spark):
    g, t = tracks(6)
    out = teta.per_sequence(spark.createDataFrame(g, SCHEMA), spark.createDataFrame(t, SCHEMA)).collect()
    n = {(s, c): sum(x[0] == s and x[3] == c for x in g) for s, *_ in g for c in ("c", "d")}
    for r in out:
        assert r.loc_tp + r.loc_fn == n[r.seq, r.cls] and min(r.loc_fp, r.loc_fn, r.cls_fp, r.cls_fn) >= 0
        if r.alpha_idx >= 10:
            assert r.cls_tp + r.cls_fn == r.loc_tp
    wrong = [r for r in out if r.cls == "c" and r.alpha_idx == 10]
    assert sum(r.cls_fn for r in wrong) > 0 and sum(r.cls_fp for r in out if r.cls == "d") > 0
