import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import runs as R
from maskloom.operators import tracks as K
from maskloom.operators.overlaps import overlapping
from maskloom.streaming.accumulate import Accumulator


def test_overlapping_leaves_nothing_out(spark):
    rng = np.random.default_rng(4)
    box = lambda: [float(v) for v in rng.integers(-1, 6, 4)] if rng.random() < 0.9 else None
    a = [(int(rng.integers(0, 3)), i, box()) for i in range(60)] + [(0, 90, [1.0, 1.0]), (0, 91, [1.0, None, 2.0, 2.0])]
    b = [(int(rng.integers(0, 3)), i, box()) for i in range(60)]

    def iou(p, q):
        if p is None or q is None or len(p) < 4 or None in p or min(*p[2:], *q[2:]) <= 0:
            return 0
        w, h = (max(0.0, min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k])) for k in (0, 1))
        return w * h / (p[2] * p[3] + q[2] * q[3] - w * h)

    want = {(i, j): iou(p, q) for g, i, p in a for h, j, q in b if g == h and iou(p, q) > 0}
    x = spark.createDataFrame(a, "g INT, i INT, p ARRAY<DOUBLE>")
    y = spark.createDataFrame(b, "g INT, j INT, q ARRAY<DOUBLE>")
    assert {(r.i, r.j): r.iou for r in overlapping(x, y, ["g"], "p", "q").collect()} == pytest.approx(want)


def test_one_sided_frames_count(spark):
    s = "k INT, t INT, id BIGINT, box ARRAY<DOUBLE>"
    g = spark.createDataFrame([(1, 0, 7, [0.0, 0.0, 2.0, 2.0]), (1, 1, 7, [0.0, 0.0, 2.0, 2.0]), (1, 2, 7, None)], s)
    d = spark.createDataFrame([(1, 0, 9, [0.0, 0.0, 2.0, 2.0]), (1, 5, 9, [9.0, 9.0, 1.0, 2.0]), (2, 0, 9, [0.0, 0.0, 2.0, 2.0])], s)
    assert [(r.gt, r.det, r.iou) for r in K.track_pairs(g, d, ["k"]).collect()] == [(7, 9, 4 / 10)]


def mask(*rows):
    return R.from_pixels(np.array([[c == "x" for c in r] for r in rows]))


def test_masks_of_a_frame(spark):
    df = spark.createDataFrame([(1, 1, 0.5, mask("xx.", "xx.")), (1, 2, 0.9, mask(".xx", ".xx")), (1, 3, 0.1, mask("x..", "...")), (1, 4, None, None)], f"f INT, id BIGINT, score DOUBLE, mask {R.MASK}")
    pairs = {(r.id, r.other): r.similarity for r in K.mask_pairs(df, ["f"]).collect()}
    assert pairs == pytest.approx({(1, 2): 2 / 6, (1, 3): 1 / 4})
    left = {r.id: r.a for r in K.resolved(df, ["f"]).select("id", R.mask_area(F.col("mask")).alias("a")).collect()}
    assert left == {1: 2, 2: 4, 3: 0, 4: None}
    assert K.resolved(df.limit(0), ["f"]).count() == 0


def test_best_candidates(spark):
    c = spark.createDataFrame([(1, 1, 1, 0.0, 0.9), (1, 1, 2, 0.2, 0.1), (2, 1, 1, 0.0, 0.3), (2, 1, 2, 0.0, 0.8), (2, 2, 5, 0.0, 0.8), (2, 2, 4, 0.0, 0.8)], "batch INT, k INT, id INT, iou DOUBLE, score DOUBLE")
    assert {(r.batch, r.k, r.id) for r in K.best_of_several(c, ["k"]).collect()} == {(1, 1, 2), (2, 1, 2), (2, 2, 4)}
    m = spark.createDataFrame([(0.5, 4), (1.0, 0)], "iou DOUBLE, target_area INT")
    assert K.mean_mask_iou(m).first().miou == 0.5 and K.mean_mask_iou(m.limit(0)).first().miou == 1
    d = spark.createDataFrame([("a", 0, 1, "c"), ("a", 0, 2, "d"), ("a", 0, 3, "d")], "seq STRING, t INT, id INT, cls STRING")
    out = K.unmatched_out(d, d.where("id = 3"), spark.createDataFrame([("a", "c")], "seq STRING, cls STRING"))
    assert {r.id for r in out.collect()} == {1, 3}


def test_rotated(spark):
    rows = [([5.0, 5.0, 4.0, 2.0, 0.0], [5.0, 5.0, 2.0, 4.0, 90.0], 1.0), ([0.0, 0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0, 45.0], None), ([0.0, 0.0, 2.0, 2.0, 0.0], [9.0, 0.0, 2.0, 2.0, 30.0], 0.0), ([0.0, 0.0, 0.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0, 45.0], 0.0)]
    got = [r.v for r in spark.createDataFrame([r[:2] for r in rows], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>").select(K.rotated_iou(F.col("a"), F.col("b")).alias("v")).collect()]
    common = 8 * (np.sqrt(2) - 1)
    assert got == pytest.approx([1.0, common / (8 - common), 0.0, 0.0])


def test_counters_are_exact_after_a_repeat(spark, tmp_path):
    acc = Accumulator(spark, str(tmp_path / "c"), ["k"], ["n"])
    batch = lambda *rows: spark.createDataFrame(rows, "k STRING, n BIGINT")
    for number, rows in ((0, [("a", 1), ("b", 2)]), (1, [("a", 5), ("a", 1)]), (1, [("a", 5), ("a", 1)]), (2, [("b", 1)])):
        acc.update(batch(*rows), number)
    want = {("a", 7), ("b", 3)}
    assert {tuple(r) for r in acc.current().collect()} == want
    acc.compact()
    acc.update(batch(("b", 1)), 2)
    assert {tuple(r) for r in acc.current().collect()} == want
    acc.reset()
    assert not (tmp_path / "c").exists()
