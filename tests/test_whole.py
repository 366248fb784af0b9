"""Queries run over all categories, images, objects and tracks."""

from pyspark.sql import functions as F

from maskloom.functions import runs as R
from maskloom.operators.reshape import explode_tracks
from maskloom.operators.results import dangling_frames, frame_tables
from maskloom.plans import registry
from maskloom.shared import table


def test_chunks_of_all_categories(spark, sf):
    rows = registry.QUERIES["category_chunks"](spark, sf).collect()
    ids = {r.id for r in table(spark, sf, "category").where("id IS NOT NULL").select("id").distinct().collect()}
    assert max(ids) > 300
    sizes = {r.chunk: r.n_categories for r in rows}
    assert sum(sizes.values()) == len(ids)
    assert sorted(sizes) == list(range(-(-len(ids) // 100)))
    videos = table(spark, sf, "video").select("id").distinct()
    pairs = table(spark, sf, "video_np_pair").select("video_id", "category_id").distinct().join(videos, F.col("video_id") == F.col("id"), "left_semi")
    assert sum(r.n_positive for r in rows) == pairs.where(F.col("category_id").isin(ids)).count()


def test_geometry_of_all_images(spark, sf):
    rows = registry.QUERIES["sample_geometry"](spark, sf)
    n = {r.image: r.n for r in rows.groupBy("image").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(n) > {0, 1}
    d = table(spark, sf, "datapoint").select("datapoint_id", "images").dropDuplicates(["datapoint_id"])
    o = d.select("datapoint_id", F.posexplode("images").alias("image", "i")).select("datapoint_id", "image", F.explode("i.objects").alias("o"))
    whole = o.where("size(o.bbox) >= 4 AND NOT exists(slice(o.bbox, 1, 4), v -> v IS NULL)")
    assert rows.count() == whole.count()


def test_areas_padded_to_the_longest(spark, sf):
    rows = registry.QUERIES["padded_objects"](spark, sf).collect()
    sizes = [n for r in rows for n in r.sizes]
    assert max(sizes) > 6
    assert {len(a) for r in rows for a in r.areas} == {max(sizes)}
    d = {r.datapoint_id: [[o.area for o in i.objects or []] for i in r.images] for r in table(spark, sf, "datapoint").select("datapoint_id", "images").collect()}
    for r in rows:
        assert [a[:n] for a, n in zip(r.areas, r.sizes, strict=True)] == d[r.datapoint_id]
        assert all(v == -1.0 for a, n in zip(r.areas, r.sizes, strict=True) for v in a[n:])


def test_annotations_of_all_tracks(spark, sf):
    rows = registry.QUERIES["frame_annotations"](spark, sf).collect()
    lost = registry.QUERIES["frame_dangling"](spark, sf).collect()
    m = table(spark, sf, "masklet").dropDuplicates(["id"])
    tracks = {r.id for r in explode_tracks(m, ["id"]).select("id").distinct().collect()}
    assert rows and lost and {r.track_id for r in rows} | {r.track_id for r in lost} == tracks
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    images = {r.id: (r.video_id, r.frame_index) for r in registry.QUERIES["frame_numbers"](spark, sf).collect()}
    assert all(images[r.image_id] == (r.video_id, r.frame_index) for r in rows)
    assert not {(r.video_id, r.frame_index) for r in lost} & set(images.values())


def test_dangling_frames(spark):
    v = spark.createDataFrame([(5, 2, 2, ["a"]), (6, 2, 2, None)], "id BIGINT, height INT, width INT, file_names ARRAY<STRING>")
    box = [0.0, 0.0, 1.0, 2.0]
    schema = f"id BIGINT, video_id BIGINT, category_id BIGINT, iscrowd INT, bboxes ARRAY<ARRAY<DOUBLE>>, segmentations ARRAY<{R.MASK}>, areas ARRAY<DOUBLE>"
    t = spark.createDataFrame([(1, 5, 1, 0, [box, box], None, None), (2, None, 1, 0, [box], None, None), (3, 7, 1, 0, [box], None, [1.0]), (4, 6, 1, 0, [box], None, None)], schema)
    assert {(r.track_id, r.frame_index, r.reason) for r in dangling_frames(v, t).collect()} == {(1, 1, "frame"), (2, 0, "null"), (3, 0, "video"), (4, 0, "frame")}
    assert [(r.id, r.image_id, r.track_id, r.area) for r in frame_tables(v, t, strict=False)["annotations"].collect()] == [(1, 1, 1, 2.0)]


def test_boundaries_of_different_masks(spark, sf):
    rows = {(r.id, r.frame): r.f for r in registry.QUERIES["mask_boundary_overlap"](spark, sf).collect()}
    assert any(f is not None and 0 < f < 1 for f in rows.values())
    masks = {r.id: r.segmentations for r in table(spark, sf, "masklet").select("id", "segmentations").dropDuplicates(["id"]).collect()}
    for (i, frame), f in list(rows.items())[:50]:
        a, b = masks[i][frame], masks[i][frame + 1]
        if f is not None:
            assert abs(f - R.boundary_f(R.pixels(a.counts, a.size), R.pixels(b.counts, b.size))) < 1e-9
