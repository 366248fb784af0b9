from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.operators import assign as M
from maskloom.operators import suppress as S


def best_total(w):
    w = w if w.shape[0] <= w.shape[1] else w.T
    return max((sum(w[i, p] for i, p in enumerate(own)) for own in permutations(range(w.shape[1]), w.shape[0])), default=0.0)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_hungarian_total(n, m, rnd):
    w = np.array([[rnd.choice([0.0, 0.25, rnd.random()]) for _ in range(m)] for _ in range(n)])
    pairs = M.hungarian(w)
    assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
    assert sum(w[p] for p in pairs) == pytest.approx(best_total(w))


def test_assign_equals_dense(spark):
    rng = np.random.default_rng(3)
    rows, totals = [], {}
    for g in range(40):
        w = rng.random((rng.integers(1, 5), rng.integers(1, 6))) * (rng.random() < 0.9)
        w[rng.random(w.shape) < 0.4] = 0
        totals[g] = best_total(w)
        rows += [(g, i + 1, j + 1, float(w[i, j]), "x") for i, j in np.ndindex(w.shape)]
    rows += [(99, 1, 1, float("nan"), "x"), (99, 1, 2, None, "x"), (None, 1, 1, 0.5, "x")]
    out = M.assign(spark.createDataFrame(rows, "g INT, left BIGINT, right BIGINT, weight DOUBLE, extra STRING"), ["g"]).collect()
    for g, total in totals.items():
        own = [r for r in out if r.g == g]
        assert len({r.left for r in own}) == len(own) == len({r.right for r in own})
        assert sum(r.weight for r in own) == pytest.approx(total)


def greedy(pairs, t):
    taken, out = set(), set()
    for d in sorted({(-s, d) for d, s, _, _ in pairs}):
        free = [(iou, -gt) for e, _, gt, iou in pairs if e == d[1] and iou >= t and gt not in taken]
        if free:
            iou, gt = max(free)
            taken.add(-gt)
            out.add((d[1], -gt))
    return out


def test_greedy_by_score(spark):
    rng, rows, by = np.random.default_rng(5), [], {}
    for g in range(30):
        scores = rng.choice([0.2, 0.5, 0.9, 0.9], 12)
        by[g] = [(d, float(scores[d]), gt, float(rng.choice([0.5, 0.6, 0.75, 0.9, 0.3]))) for d in range(12) for gt in range(4) if rng.random() < 0.4]
        rows += [(g, *p) for p in by[g]]
    out = M.greedy_by_score(spark.createDataFrame(rows, "g INT, det BIGINT, score DOUBLE, gt BIGINT, iou DOUBLE"), ["g"], [0.5, 0.75]).collect()
    for g, pairs in by.items():
        for k, t in enumerate([0.5, 0.75]):
            assert {(r.det, r.gt) for r in out if (r.g, r.thr_idx) == (g, k)} == greedy(pairs, t)


def iou(a, b):
    w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    u = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / u if u > 0 else 0.0


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("chunk", [3, 1000])
def test_suppression_in_rounds(spark, inclusive, chunk):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3)), i, float(rng.choice([0.1, 0.5, 0.5, 0.9])), [float(v) for v in rng.integers(1, 9, 4)]) for i in range(120)]
    rows += [(0, 500, None, [1.0, 1.0, 4.0, 4.0]), (0, 501, float("nan"), None), (None, 502, 0.3, [1.0, 2.0]), (0, 503, 0.9, [1.0, 1.0, 0.0, 0.0])]
    got = S.suppress_boxes(spark.createDataFrame(rows, "g INT, id BIGINT, score DOUBLE, bbox ARRAY<DOUBLE>"), ["g"], 0.25, inclusive, chunk=chunk).collect()
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for _, i, s, b in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] if r[2] is not None and r[2] == r[2] else -9.0), r[1])):
            b = b if b is not None and len(b) >= 4 else [0.0] * 4
            if not any((o >= 0.25 if inclusive else o > 0.25) for o in (iou(b, k) for k in kept)):
                kept.append(b)
                want.add((g, i))
    assert {(r.g, r.id) for r in got} == want and len(got) == len(want)


def test_pairs_and_occlusion(spark):
    items = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (2, 1, None)], "g INT, id BIGINT, score DOUBLE")
    pairs = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.5)], "g INT, id BIGINT, other BIGINT, similarity DOUBLE")
    assert {(r.g, r.id) for r in S.suppress_pairs(items, pairs, ["g"], lambda s: s > 0.4).collect()} == {(1, 1), (1, 3), (2, 1)}
    p = spark.createDataFrame([(1, 1, 2, 0.9, 5, None), (2, 1, 2, 0.9, 3, 3), (3, 1, 2, 0.6, 9, 1), (4, 1, 2, 0.7, 1, 4)], "frame INT, a BIGINT, b BIGINT, similarity DOUBLE, last_a INT, last_b INT")
    assert {tuple(r) for r in S.suppress_occluded(p).collect()} == {(4, 2)}  # in frame 1 b never was occluded
    assert {tuple(r) for r in S.suppress_occluded(p, reverse=True).collect()} == {(1, 2), (4, 1)}


def test_association(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, None)], "frame INT, det BIGINT, score DOUBLE")
    t = spark.createDataFrame([(1, 7), (1, 8)], "frame INT, track BIGINT")
    p = spark.createDataFrame([(1, 1, 7, 0.6), (1, 1, 8, 0.1)], "frame INT, det BIGINT, track BIGINT, iou DOUBLE")
    dets, trks = M.associate(d, t, p)
    assert {(r.det, tuple(r.tracks), r.is_new) for r in dets.collect()} == {(1, (7, 8), False), (2, (), True), (3, (), False)}
    assert {(r.track, r.is_unmatched) for r in trks.collect()} == {(7, False), (8, True)}
    assert M.one_to_many(p.limit(0).selectExpr("frame", "det AS detection", "track AS target", "iou AS probability", "iou"), ["frame"]).count() == 0
    assert F is not None
