import pytest
from pyspark.sql import functions as F

from maskloom.functions import runs as R
from maskloom.operators import results as S
from maskloom.plans.session import SessionLog


def test_rows_of_packed_predictions(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0, 2.0, 3.0], [1.0, 1.0, 2.0, 2.0]], [0.5], [7, 8]), (2, [], [], []), (3, None, None, None)], "image_id INT, boxes ARRAY<ARRAY<DOUBLE>>, scores ARRAY<DOUBLE>, labels ARRAY<INT>")
    assert [tuple(r) for r in S.result_rows(df).orderBy("category_id").collect()] == [(1, 7, [0, 0, 2, 3], 0.5), (1, 8, [1, 1, 1, 1], None)]


def test_frame_tables(spark):
    v = spark.createDataFrame([(5, 2, 2, ["a", "b"]), (4, 2, 2, ["c"])], "id BIGINT, height INT, width INT, file_names ARRAY<STRING>")
    box = [0.0, 0.0, 1.0, 2.0]
    schema = f"id BIGINT, video_id BIGINT, category_id BIGINT, iscrowd INT, bboxes ARRAY<ARRAY<DOUBLE>>, segmentations ARRAY<{R.MASK}>, areas ARRAY<DOUBLE>"
    t = S.frame_tables(v, spark.createDataFrame([(9, 5, 1, 0, [None, box], [None, None], [None, None])], schema))
    assert {(r.video_id, r.frame_index): r.id for r in t["images"].collect()} == {(4, 0): 1, (5, 0): 2, (5, 1): 3}
    assert [(r.id, r.image_id, r.track_id, r.area) for r in t["annotations"].collect()] == [(1, 3, 9, 2.0)]
    with pytest.raises(Exception, match="no frame 1 in video 4"):
        S.frame_tables(v, spark.createDataFrame([(9, 4, 1, 0, [None, box], [None, None], [None, None])], schema))["annotations"].collect()


def test_versions_stages_and_orders(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "k INT, version INT, v STRING")
    b = spark.createDataFrame([(1, 2, "new"), (3, 1, "more")], "k INT, version INT, v STRING")
    assert {r.k: r.v for r in S.latest_versions(a, b, ["k"]).collect()} == {1: "new", 2: "kept", 3: "more"}
    assert sorted(r.stage for r in S.stages_together([a, b]).collect()) == [0, 0, 1, 1]
    m = spark.createDataFrame([(1, 1, 0, 0, 0.5), (1, 1, 0, 1, 0.5), (1, 1, 1, 0, None)], "media INT, object INT, frame INT, mask_no INT, score DOUBLE")
    assert {(r.frame, r.mask_no) for r in S.best_mask(m).collect()} == {(0, 0), (1, 0)}
    s, v = S.by_score(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.1)), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    assert tuple(spark.range(1).select(s, v).first()) == ([0.9, 0.1, 0.1], ["b", "a", "c"])
    f = spark.createDataFrame([(0, "t", "d", 0.9, 0.9), (1, "t", "d", 0.9, 0.9), (1, "t", "d", 0.1, 0.9), (2, "t", "d", 0.1, 0.2), (4, "t", None, None, None)], "frame INT, mask STRING, det_mask STRING, det_iou DOUBLE, det_score DOUBLE")
    assert [r.mask for r in S.reconditioned(f, 4).collect()] == ["d", "t", "d", "t", "t"]
    p = spark.createDataFrame([(1, 3)], "left BIGINT, right BIGINT")
    assert {r.right for r in S.repeated_targets(p, 2).collect()} == {6, 7}


def test_session_requests(spark, tmp_path):
    s = SessionLog(spark, str(tmp_path / "log"), 10)
    ask = lambda kind, **x: s.handle({"type": kind, "session_id": "a", **x})
    ask("start_session")
    assert ask("propagate", frame_idx=0)["propagation_type"] == "propagation_full"
    ask("add_prompt", obj_ids=[3], frame_idx=2)
    assert ask("propagate", frame_idx=2) == {"session_id": "a", "propagation_type": "propagation_partial", "obj_ids": [3]}
    ask("close_session")
    ask("close_session")
    with pytest.raises(ValueError, match="no open session"):
        ask("add_prompt")
    with pytest.raises(ValueError, match="unknown request"):
        ask("zap")
