import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.functions import runs as R
from maskloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def box(*v):
    return F.array(*(F.lit(None).cast("double") if x is None else F.lit(float(x)) for x in v))


@pytest.mark.parametrize(("source", "target"), [k for k in B.CONVERSIONS if (k[1], k[0]) in B.CONVERSIONS])
def test_conversions_invert(spark, source, target):
    b = box(3, 4, 10, 20)
    assert one(spark, B.convert(B.convert(b, source, target), target, source)) == [3, 4, 10, 20]


def test_overlap_values_and_edges(spark):
    a, b = box(0, 0, 2, 2), box(1, 1, 2, 2)
    assert one(spark, B.iou_xywh(a, b)) == 1 / 7
    assert one(spark, B.iou_xywh(a, box(2, 0, 2, 2))) == 0
    assert one(spark, B.iou_xywh(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, B.iou_xywh(a, box(1, None, 2, 2))) is None and one(spark, B.iou_xywh(a, box(1, 1))) is None
    assert one(spark, B.giou_xyxy(box(0, 0, 1, 1), box(2, 0, 3, 1))) == pytest.approx(-1 / 3)
    assert one(spark, B.ioa_xyxy(box(0, 0, 2, 2), box(1, 1, 5, 5), "first")) == 0.25
    assert one(spark, B.iom_xywh(box(0, 0, 4, 4), box(1, 1, 2, 2))) == 1
    assert one(spark, B.clamp(box(-1, None, 2))) == [0, None, 1]
    assert [one(spark, B.is_zero(x)) for x in (box(1, 2), box(0, 0, 0, 0), box(None, -1, 0, 0), box(0, 0, 0, 1), F.lit(None).cast("array<double>"))] == [True, True, True, False, True]
    assert one(spark, B.xywha_to_xyxy(box(5, 5, 4, 2, 90))) == pytest.approx([4, 3, 6, 7])
    assert one(spark, B.normal_angle(F.lit(540.0))) == -180
    assert one(spark, B.near_border(box(0.0, 0.4, 0.02, 0.1)))


masks = st.integers(0, 2**24 - 1).map(lambda n: np.array([n >> i & 1 for i in range(24)], bool).reshape(4, 6))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(masks, masks), min_size=1, max_size=5))
def test_run_algebra(pairs):
    a, b = ([R.from_pixels(p[i]) for p in pairs] for i in (0, 1))
    x, y = (R.Runs.parse([t for t, _ in m], [s for _, s in m]) for m in (a, b))
    assert x.valid.all() and x.areas().tolist() == [int(p.sum()) for p, _ in pairs]
    assert x.intersections(y)[0].tolist() == [int((p & q).sum()) for p, q in pairs]
    for (p, q), s, t, own in zip(pairs, a, b, x.boxes(), strict=True):
        assert np.array_equal(R.pixels(*s), p)
        assert R.combine([s, t]) == R.from_pixels(p | q) and R.combine([s, t], True) == R.from_pixels(p & q)
        ys, xs = np.nonzero(p)
        assert own.tolist() == ([xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1] if len(xs) else [0] * 4)


@settings(max_examples=60, deadline=None)
@given(masks)
def test_parts_and_distances(m):
    labels, area = R.components(m)
    seen = {}
    for y, x in zip(*np.nonzero(m), strict=True):
        seen.setdefault(labels[y, x], []).append((y, x))
    assert all((area[y, x] == len(v)) for v in seen.values() for y, x in v)
    for a, b in product(zip(*np.nonzero(m), strict=True), repeat=2):
        if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1:
            assert labels[a] == labels[b]
    background = np.argwhere(~m)
    if len(background):
        for y, x in zip(*np.nonzero(m), strict=True):
            assert math.isclose(R.distance(m)[y, x], np.sqrt(((background - [y, x]) ** 2).sum(1)).min())
    assert np.array_equal(R.dilate(m, 3), np.array([[m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(6)] for y in range(4)]))
    kept = R.non_overlapping([m, np.ones_like(m)], [0.5, 0.5])
    assert np.array_equal(kept[0], m) and np.array_equal(kept[1], ~m)


def test_malformed_masks(spark):
    rows = [("00", [2, 2]), (None, [2, 2]), ("0", None), ("~~", [2, 2]), ("04", [2, 2]), ("", [0, 0]), ("`", [4, 4]), ("5", [2, 2])]
    df = spark.createDataFrame([((c, s),) for c, s in rows] + [(None,)], f"m {R.MASK}")
    got = df.select(R.mask_area(F.col("m")).alias("a"), R.mask_box(F.col("m")).alias("b"), R.mask_components(F.col("m")).alias("n")).collect()
    assert [r.a for r in got] == [None, None, None, None, 4, 0, None, None, None]
    assert got[4].b == [0, 0, 2, 2] and got[4].n == 1 and got[5].b == [0, 0, 0, 0]
    same = df.where("m.counts = '04'").select(R.mask_iou(F.col("m"), F.col("m")).alias("iou"), R.mask_boundary_f(F.col("m"), F.col("m")).alias("f"), R.union_masks(F.array("m", F.lit(None))).alias("u")).first()
    assert same.iou == 1 and same.f == 1 and same.u.counts == "04"


def test_boxes_of_seven_masks():
    """The box expectations of the surveyed unit test, on rectangles: corners are pixel indices."""
    for x0, y0, x1, y1 in ([127, 2, 165, 40], [2, 50, 44, 92], [56, 63, 98, 100], [139, 68, 175, 104], [160, 112, 198, 145], [49, 138, 99, 182], [108, 148, 152, 213]):
        m = np.zeros((220, 200), bool)
        m[y0 : y1 + 1, x0 : x1 + 1] = True
        x, y, w, h = R.Runs.parse(*([v] for v in R.from_pixels(m))).boxes()[0]
        assert [x, y, x + w - 1, y + h - 1] == [x0, y0, x1, y1]


def test_text(spark):
    cases = [
        (T.canonical(F.lit("A_b,  C!")), "a b c"), (T.canonical(F.lit("a.{}.b!"), "{}"), "a{}b"), (T.squeeze(F.lit(" a \n b ")), "a b"),
        (T.clean_lower(F.lit("ÀB")), "àb"), (T.with_affixes(F.lit(" Dog"), "x:", "", ["dog"]), "x: Dog"), (T.with_affixes(F.lit("cat"), "x:", "", ["dog"]), "cat"),
    ]
    for column, value in cases:
        assert one(spark, column) == value
    assert one(spark, T.unescape_twice(F.lit("&amp;lt; ").cast("string"))) == "<"
    assert one(spark, T.frame_address(F.lit("a/b.mp4@12"))).asDict() == {"file": "a/b.mp4", "frame": 12}
    assert one(spark, T.frame_address(F.lit("a.jpg"))).frame is None
    assert one(spark, T.hex_to_rgb(F.lit("#0a10ff"))) == [10, 16, 255]
    assert one(spark, T.heatmap_cell(F.lit(10.0), F.lit(0.0), box(0, 0, 10, 10), 4)).asDict() == {"column": 3, "row": 0}
    with pytest.raises(Exception, match="not mapped"):
        one(spark, T.mapped_or_error(F.lit("z"), {"a": "b"}))
