"""Masks as vertical pieces of whole batches, against the functions over pixels."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskloom.functions import runs as R


def shapes(n):
    rng = np.random.default_rng(8)
    for k in range(n):
        h, w = rng.integers(1, 14, 2)
        m = rng.random((h, w)) < rng.choice([0.0, 0.3, 0.5, 0.7, 1.0]) if k % 2 else np.zeros((h, w), bool)
        y, x, b, a = rng.integers(0, 9, 4)
        m[y : y + b, x : x + a] = True
        yield m


@pytest.mark.parametrize("chunk", [1, 500, 1 << 19])
def test_segments_equal_pixels(monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK_PIXELS", chunk)
    masks = list(shapes(600))
    texts = [R.from_pixels(m) for m in masks]
    s = R.Segments(R.Runs.parse([t for t, _ in texts], [z for _, z in texts]))
    dilated = {k: s.dilated_areas(k) for k in (1, 2, 3, 4)}
    centres, some = s.centres()
    for m, b, p, c, k, *d in zip(masks, s.boundary_areas(), s.parts(), centres, some, *dilated.values(), strict=True):
        assert b == R.boundary(m).sum() and p == R.components(m)[0].max(initial=0) and k == m.any()
        assert d == [R.dilate(m, size).sum() for size in dilated]
        if k:
            y, x = np.unravel_index(int(R.distance(np.pad(m, 1))[1:-1, 1:-1].argmax()), m.shape)
            assert c.tolist() == [x, y]


def test_runs_of_arrow_sizes():
    text = R.from_pixels(np.eye(5, dtype=bool))[0]
    parted = R.encode_counts([2, 3, 0, 2, 2, 0, 0, 0])  # runs of no length within the foreground
    sizes = [None, [5], [5, None], [5, 5, 1], [-5, -5], [5, 5]]
    rows = [None, {"counts": None, "size": [5, 5]}, *({"counts": text, "size": z} for z in sizes), {"counts": "", "size": [0, 5]}, {"counts": parted, "size": [3, 3]}]
    r = R.Runs.of(pa.array(rows, pa.struct([("counts", pa.string()), ("size", pa.list_(pa.int32()))]))[1:])
    assert r.valid.tolist() == [False] * 6 + [True] * 3
    assert R.Segments(r).parts().tolist()[-3:] == [1, 0, 1] and R.Segments(r).centres()[0][-1].tolist() == [1, 0]


def test_morphology_of_a_large_batch(spark):
    m = np.zeros((480, 640), bool)
    m[100:140, 200:250] = m[110:200, 240:260] = True
    text, size = R.from_pixels(m)
    df = spark.range(0, 20_000, 1, 4).select("id", F.struct(F.lit(text).alias("counts"), F.array(*map(F.lit, size)).alias("size")).alias("mask"))
    df = df.withColumn("mask", F.when(F.col("id") > 0, F.col("mask")))
    began = time.time()
    rows = df.select("id", R.mask_morphology(F.col("mask")).alias("m")).select("m.*").distinct().collect()
    assert time.time() - began < 60  # 4,842 masks took 56 s when each was put on an image of its own
    y, x = np.unravel_index(int(R.distance(m).argmax()), m.shape)
    want = (int(R.boundary(m).sum()), int(R.dilate(m, 3).sum()), 1, [int(x), int(y)])
    assert sorted(map(tuple, rows), key=repr) == [want, (None, None, None, None)]


def test_empty_images_have_no_shape(spark):
    df = spark.createDataFrame([(("", [0, 0]),), (("4", [2, 2]),)], f"mask {R.MASK}")
    assert [tuple(r.m) for r in df.select(R.mask_morphology(F.col("mask")).alias("m")).collect()] == [(0, 0, 0, None)] * 2
