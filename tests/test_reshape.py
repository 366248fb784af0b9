import json

import pytest
from pyspark.sql import functions as F

from maskloom.functions import runs as R
from maskloom.operators import aggregates as A
from maskloom.operators import filters as P
from maskloom.operators import ordered as O
from maskloom.operators import reshape as S
from maskloom.operators import samples as X
from maskloom.operators.grouped import first_copy, map_groups
from maskloom.plans import session
from maskloom.sources import datasets, files


def test_numbers_and_labels(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"))
    got = {r.k: r.n for r in S.number_rows(df, ["k"], "n", 1).collect()}
    assert got == {k: k + 1 for k in range(500)}
    assert S.number_rows(df.limit(0), ["k"], "n").count() == 0
    u = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 2), ("c", 5)], "g STRING, k BIGINT")
    assert sorted((r.g, r.k, r.new_k) for r in S.unique_ids(u, "g", "k").distinct().collect()) == [("a", 1, 6), ("b", 1, 7), ("b", 2, 8), ("c", 2, 9), ("c", 5, 5)]


def test_tracks_there_and_back(spark):
    m = ("0", [1, 1])
    rows = [(1, [None, [1.0, 2.0, 3.0, 4.0], [0.0] * 4], [None, m, None], [None, 5.0, None]), (2, None, None, None), (3, [[1.0, 1.0, 2.0, 2.0]], None, None)]
    df = spark.createDataFrame(rows, f"id INT, bboxes ARRAY<ARRAY<DOUBLE>>, segmentations ARRAY<{R.MASK}>, areas ARRAY<DOUBLE>")
    f = S.explode_tracks(df.withColumns({c: F.coalesce(c, F.array()) for c in ("bboxes", "segmentations", "areas")}).withColumn("n", F.greatest(F.size("bboxes"), F.lit(1))), ["id", "n"])
    assert [(r.id, r.frame, r.area) for r in f.orderBy("id").collect()] == [(1, 1, 5.0), (3, 0, 4.0)]
    back = {r.id: r.bboxes for r in S.pack_tracks(f, ["id"], F.col("n")).collect()}
    assert back == {1: [None, [1, 2, 3, 4], None], 3: [[1, 1, 2, 2]]}


def test_one_based(spark):
    images = spark.createDataFrame([(0,), (1,)], "id BIGINT")
    annotations = spark.createDataFrame([(5, 0), (6, 1)], "id BIGINT, image_id BIGINT")
    moved, refs = S.one_based(images, "id", {"a": (annotations, "image_id")})
    assert {r.id for r in moved.collect()} == {1, 2} and {tuple(r) for r in refs["a"].collect()} == {(5, 1), (6, 2)}
    same, _ = S.one_based(annotations, "id", {})
    assert {r.id for r in same.collect()} == {5, 6}


def test_groups_and_copies(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"), "id")
    import pyarrow as pa

    def kernel(t, bounds):
        return pa.table({"g": t.column("g").take(pa.array(bounds[:-1])), "n": [b - a for a, b in zip(bounds, bounds[1:], strict=False)]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.g: r.n for r in map_groups(df, ["g"], kernel, "g BIGINT, n BIGINT").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: len(range(g, 1000, 37)) for g in range(37)}
    c = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 3, "n"), (None, 4, "m")], "id INT, delivered_at INT, v STRING")
    assert {(r.id, r.v) for r in first_copy(c).collect()} == {(1, "a"), (None, "n")}


def test_ordered(spark):
    rows = [(1, t, h) for t, h in enumerate([True, True, False, None, True])]
    df = spark.createDataFrame(rows, "g INT, t INT, hit BOOLEAN")
    assert [r.run for r in O.match_runs(df, ["g"], "t", F.col("hit")).orderBy("t").collect()] == [1, 2, 0, 0, 1]
    assert [r.alive for r in O.keep_alive(df, ["g"], "t", F.col("hit"), 0, -1, 1).orderBy("t").collect()] == [1, 1, 0, -1, 0]
    assert [r.a for r in O.look_ahead(df, ["g"], "t", "t", 2, "a").orderBy("t").collect()] == [2, 3, 4, 4, 4]
    assert [r.t for r in O.strided(df, ["g"], "t", 1, 4, 2).orderBy("t").collect()] == [1, 3]
    assert O.top_k(df.limit(0), ["g"], [F.col("t")], 3).count() == 0


def test_aggregates(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (0.5, 0.0), (None, 0.2)], "v DOUBLE, w DOUBLE")
    r = df.agg(A.mean_of_defined(F.col("v")).alias("m"), A.weighted_mean(F.col("v"), F.col("w")).alias("w")).first()
    assert (r.m, r.w) == (0.5, 0)
    assert df.where("v = -1").agg(A.mean_of_defined(F.col("v")).alias("m")).first().m == -1
    m = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.1), (2, None, 1.0)], "g INT, l INT, s DOUBLE")
    assert [(r.g, r.l, round(r.mean_s, 6)) for r in A.majority(m, ["g"], "l", "s").collect()] == [(1, 3, 0.3)]
    with pytest.raises(Exception, match="rows 2"):
        A.one_row(df.limit(2), "rows").collect()


OBJECT = "STRUCT<bbox: ARRAY<DOUBLE>, area: DOUBLE, object_id: BIGINT, frame_index: INT, is_crowd: BOOLEAN>"
QUERY = "STRUCT<query_text: STRING, image_id: INT, object_ids_output: ARRAY<INT>, is_exhaustive: BOOLEAN, is_pixel_exhaustive: BOOLEAN, query_processing_order: INT, input_bbox: ARRAY<ARRAY<DOUBLE>>, input_points: ARRAY<ARRAY<DOUBLE>>>"
POINT = f"datapoint_id BIGINT, images ARRAY<STRUCT<size: ARRAY<INT>, objects: ARRAY<{OBJECT}>>>, find_queries ARRAY<{QUERY}>"


def points(spark):
    o = lambda i, crowd=False, area=4.0: ([0.0, 0.0, 2.0, 2.0] if area else [1.0, 1.0, 1.0, 1.0], area, i, 0, crowd)
    q = lambda text, ids, stage, box=None, image=0: (text, image, ids, True, None, stage, box, None)
    rows = [
        (1, [([9, 9], [o(10), o(11, True), o(12), o(13, area=0.0)])], [q("a", [0, 2], 0), q("b", [1], 3), q("c", [], 5, [[0.0, 0.0, 1.0, 1.0]]), q("d", [3, 2], 5), q(None, None, 5, image=7)]),
        (2, None, None), (3, [([1, 1], None)], []),
    ]
    return spark.createDataFrame(rows, POINT)


def test_query_filters(spark):
    df = points(spark)
    texts = lambda d: {r.datapoint_id: [q.query_text for q in r.find_queries or []] for r in d.collect()}[1]
    assert texts(P.keep_queries(df, P.valid_geometric)) == ["a", "b", "d", None]
    assert texts(P.keep_queries(df, P.no_zero_boxes)) == ["a", "b", "c", None]
    assert texts(P.keep_queries(df, P.at_most_outputs(1))) == ["b", "c", None]
    assert texts(P.keep_queries(df, P.text_not_in("a"))) == ["b", "c", "d", None]
    kept = {r.datapoint_id: r for r in P.drop_objects(df, lambda o: ~o["is_crowd"]).collect()}[1]
    assert [o.object_id for o in kept.images[0].objects] == [10, 12, 13] and [q.object_ids_output for q in kept.find_queries] == [[0, 1], [], [], [2, 1], None]
    first = {r.datapoint_id: r for r in P.drop_orphan_objects(P.keep_queries(df, P.text_not_in("a", "b", "c"))).collect()}[1]
    assert [o.object_id for o in first.images[0].objects] == [12, 13] and first.find_queries[0].object_ids_output == [1, 0] and first.find_queries[0].query_processing_order == 0


def test_sample_choices(spark):
    df = points(spark)
    two = [q.query_text for q in {r.datapoint_id: r for r in X.cap_queries(df, 2, 1, True).collect()}[1].find_queries]
    assert len(two) == 2 and set(two) <= {"a", "b", "d"} and two == sorted(two)
    assert {r.datapoint_id: len(r.find_queries) for r in X.cap_queries(df, 9, 1).collect()} == {1: 5, 2: 0, 3: 0}
    swapped = {r.datapoint_id: r for r in X.text_or_target(df, 3, 1.1).collect()}[1].find_queries
    assert [q.query_text for q in swapped] == ["visual", "visual", "c", "visual", None]
    assert {r.datapoint_id: len(r.find_queries) for r in X.same_queries_per_frame(df, 1, 4).collect()}[2] == 0
    x = spark.range(5000).select(X.draw(1, F.col("id")).alias("u"))
    r = x.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(r.m - 0.5) < 0.02 and 0 <= r.lo < r.hi < 1
    assert spark.range(1).select(X.sampled_stages(F.array(*map(F.lit, range(10))), 4, 5).alias("s")).first().s == [0, 3, 6, 9]
    good, bad = X.with_quarantine(spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "j STRING"), "j", "a INT, _bad STRING")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 2


def test_plans_from_logs(spark):
    rows = [
        (1, 1, "add", 0, [4]), (1, 2, "refine", 0, [5, 4]), (2, 1, "add", 0, [1]), (2, 2, "propagation_full", 3, None), (3, 1, "propagation_full", 0, None), (4, 1, "propagation_partial", 4, [2]), (4, 2, "propagation_partial", 5, [2]),
        (5, 1, "propagation_fetch", 4, None), (6, 1, "propagation_full", 1, None), (6, 2, "remove", 1, [9]), (7, 1, "add", 0, [1]), (7, 2, "propagation_full", 1, None), (7, 3, "add", 0, [3]), (7, 4, "remove", 0, [1]),
    ]
    log = spark.createDataFrame(rows, "session_id INT, seq BIGINT, type STRING, frame_idx INT, obj_ids ARRAY<BIGINT>")
    got = {r.session_id: (r.propagation_type.removeprefix("propagation_"), r.obj_ids) for r in session.plan(session.checked(log), 10).collect()}
    assert got == {1: ("partial", [4, 5]), 2: ("full", None), 3: ("fetch", None), 4: ("fetch", None), 5: ("fetch", None), 6: ("fetch", None), 7: ("partial", [3])}
    with pytest.raises(Exception, match="unknown action"):
        session.checked(log.withColumn("type", F.lit("zap"))).collect()
    req = spark.createDataFrame([(1, 1, "start_session"), (2, 1, "start_session"), (2, 2, "close_session"), (2, 3, "close_session"), (3, 1, "close_session")], "session_id INT, seq INT, type STRING")
    assert [r.session_id for r in session.open_sessions(req).collect()] == [1]
    assert spark.range(1).select(session.verdict(F.lit("x <verdict> accept </verdict>")).alias("v"), session.verdict(F.lit("none")).alias("n")).first() == ("Accept", None)


def test_dataset_documents(spark, tmp_path):
    doc = {
        "info": {}, "images": [{"id": 1, "file_name": "a", "width": 4, "height": 3, "queried_category": "7", "is_instance_exhaustive": 1, "text_input": "dog"}, {"id": 2, "queried_category": "x"}],
        "annotations": [{"id": 5, "image_id": 1, "bbox": [0, 0, 1, 1], "segmentation": {"counts": [5, 2, 5], "size": [3, 4]}, "category_id": 1}, {"id": 4, "image_id": 1, "segmentation": {"counts": "525", "size": [3, 4]}}, {"id": 6, "image_id": 1, "segmentation": [[0, 0, 1, 1, 2, 2]]}],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    d = datasets.read_dataset(spark, str(tmp_path / "d.json"))
    assert [r.queried_category for r in d["images"].orderBy("id").collect()] == [7, None] and d["categories"].count() == 0
    a = {r.id: r.segmentation for r in d["annotations"].collect()}
    assert a[5].counts == R.encode_counts([5, 2, 5]) and a[4].counts == "525" and a[6] is None
    grouped = {r.id: [x.id for x in r.annotations] for r in datasets.grouped_by_image(d["images"].select("id"), d["annotations"].select("id", "image_id")).collect()}
    assert grouped == {1: [4, 5, 6], 2: []}
    assert datasets.image_queries(d["images"]).where("query_text = 'dog'").first().is_exhaustive
    res = [{"image_id": 1, "score": 0.5, "segmentation": {"counts": "525", "size": [3, 4]}}, {"image_id": 9, "score": 0.1, "bbox": [0, 0, 2, 3]}, {"image_id": 1, "keypoints": [1, 2, 2, 4, 6, 2]}]
    (tmp_path / "r.json").write_text(json.dumps(res))
    rows = datasets.read_results(spark, str(tmp_path / "r.json")).collect()
    assert sorted(r.area for r in rows) == sorted([R.Runs.parse(["525"], [[3, 4]]).boxes()[0][2:].prod(), 6, 12])
    with pytest.raises(Exception, match="unknown image_id: 9"):
        datasets.read_results(spark, str(tmp_path / "r.json"), d["images"]).collect()
    c = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "id BIGINT, name STRING")
    assert datasets.category_chunks(d["images"].select("id"), c, 2).count() == 6
    with pytest.raises(ValueError):
        datasets.category_chunks(d["images"], c, 2, most=3)


def test_video_documents(spark, tmp_path):
    doc = {"videos": [{"id": 3, "file_names": ["x/0", "x/1"], "length": 2}], "annotations": [{"id": 1, "video_id": "3", "bboxes": [None, [0, 0, 1, 1]], "areas": [None, 1.0], "segmentations": [None, {"counts": "1", "size": [1, 1]}]}], "categories": [{"id": 8, "name": "dog"}], "video_np_pairs": [{"id": 1, "video_id": 3, "category_id": 8, "noun_phrase": "dog", "num_masklets": 1}]}
    (tmp_path / "v.json").write_text(json.dumps(doc))
    d = datasets.read_dataset(spark, str(tmp_path / "v.json"), video=True)
    a = d["annotations"].first()
    assert (a.video_id, a.bboxes[0], a.mean_area) == (3, [0, 0, 0, 0], 0.5)
    assert [(r.frame, r.query_text) for r in datasets.video_queries(d["video_np_pairs"], d["videos"], d["categories"]).collect()] == [(0, "dog"), (1, "dog")]


def test_text_files_and_sinks(spark, tmp_path):
    (tmp_path / "mot.txt").write_text("0 1 a x\n0 -1 b y\n1.0 2 c x\n")
    rows = files.read_mot(spark, str(tmp_path / "mot.txt"), ["t", "id", "kind", "cls"])
    assert {(r.t, r.id) for r in rows.collect()} == {(0, 1), (0, -1), (1, 2)}
    data, ignored = files.mot_rows(rows, {"cls": ["X"]}, {"kind": ["c"]}, {"cls": {"x": "X"}}, True)
    assert [r.id for r in data.collect()] == [1] and [r.id for r in ignored.collect()] == [2]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": 2}\n\n')
    assert files.last_json_rows(spark, str(tmp_path / "log.jsonl"), "a INT").first().a == 2
    assert files.parameters("a:\n  b: 1 # x\n  c:\n    d: 'y'\ne: z") == {"a.b": "1", "a.c.d": "y", "e": "z"}
    found = files.find_files(spark, str(tmp_path), "*.txt").collect()
    assert len(found) == 1 and found[0].length > 0 and files.find_files(spark, str(tmp_path), "*.txt", "mot").count() == 0
    out = spark.createDataFrame([([0.123455, 0.123465], 0.5, 1.0)], "bbox ARRAY<DOUBLE>, score DOUBLE, area DOUBLE")
    files.write_results(out, str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res")).first().bbox == [0.12346, 0.12346]
    summary = spark.createDataFrame([(0.5, 0.25)], "HOTA DOUBLE, DetA DOUBLE")
    files.write_summary(summary, str(tmp_path / "sum"))
    assert files.read_summary(spark, str(tmp_path / "sum")).first() == (50.0, 25.0)
    for step in (1, 2):
        files.append_scalars(spark.createDataFrame([("x", float(step))], "metric STRING, value DOUBLE"), step, str(tmp_path / "log"))
    assert [r.x for r in files.dashboard(spark.read.parquet(str(tmp_path / "log"))).collect()] == [1.0, 2.0]
