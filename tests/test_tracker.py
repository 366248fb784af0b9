import numpy as np
from pyspark.sql import functions as F

from maskloom.shared import scratch
from maskloom.streaming.tracker import IN, OUT, Settings, Tracker, track_batch, track_stream

QUICK = Settings(hotstart_delay=3, unmatched_limit=2, duplicate_limit=2, confirm_after=2, new_score=0.5)


def run(frames, settings=QUICK):
    t, out = Tracker(settings), []
    for f, d in enumerate(frames):
        t = Tracker.load(t.dump(), settings)
        out += t.step(f, d, f == len(frames) - 1)
    return {(r["frame_idx"], r["obj_id"]) for r in out}


A, FAR = [0.0, 0.0, 10.0, 10.0], [50.0, 50.0, 10.0, 10.0]


def test_confirmed_track_is_emitted_from_its_start():
    assert run([[(0.9, A)]] * 5) == {(f, 0) for f in range(5)}


def test_flicker_is_removed_everywhere():
    assert run([[(0.9, A), (0.9, FAR)], *[[(0.9, A)]] * 5]) == {(f, 0) for f in range(6)}


def test_weak_detections_begin_nothing():
    assert run([[(0.4, A)]] * 4) == set()


def test_object_limit_keeps_the_best():
    one = Settings(hotstart_delay=0, unmatched_limit=0, duplicate_limit=0, new_score=0.1, max_objects=1)
    t = Tracker(one)
    assert [r["box"] for r in t.step(0, [(0.3, A), (0.9, FAR)], False)] == [FAR]


def test_keep_alive_is_clamped():
    s = Settings(hotstart_delay=0, unmatched_limit=0, keep_alive_start=1, keep_alive_low=-1, keep_alive_high=2, suppress_only_in_hotstart=False, new_score=0.1)
    t = Tracker(s)
    t.step(0, [(0.9, A)], False)
    for f in range(1, 6):
        t.step(f, [(0.9, A)], False)
    assert t.objects[0].keep_alive == 2
    for f in range(6, 12):
        t.step(f, [], False)
    assert t.objects[0].keep_alive == -1


def test_keep_alive_rises_once_a_frame():
    t = Tracker(Settings(hotstart_delay=0, unmatched_limit=0, keep_alive_start=0, keep_alive_high=9, new_score=0.1))
    t.step(0, [(0.9, A)], False)
    t.step(1, [(0.9, A), (0.8, [1.0, 0.0, 10.0, 10.0])], False)
    assert t.objects[0].keep_alive == 1


def frames(spark):
    rng, rows = np.random.default_rng(9), []
    for video in range(6):
        base = rng.integers(0, 60, (4, 2))
        for f in range(12):
            d = [(float(rng.random() * 0.6 + 0.4), [float(x + f), float(y), 8.0, 8.0]) for x, y in base if rng.random() < 0.8]
            rows.append((video, f, 12, d))
    return spark.createDataFrame(rows, IN)


def key(df):
    return sorted((r.video_id, r.frame_idx, r.obj_id, r.score, tuple(r.box)) for r in df.collect())


def test_stream_equals_batch(spark):
    df = frames(spark)
    want = key(track_batch(df, QUICK))
    assert want and key(track_batch(df.orderBy(F.rand(3)), QUICK)) == want
    source, out, marks = (scratch(spark, n) for n in ("in", "out", "marks"))
    for part in range(3):  # each file is a micro-batch
        df.where(f"frame_idx DIV 4 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = track_stream(spark.readStream.schema(IN).option("maxFilesPerTrigger", 1).parquet(source), QUICK)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.read.schema(OUT).parquet(out)) == want


def test_late_and_null_frames(spark):
    rows = [(1, 0, 3, [(0.9, A)]), (1, 1, 3, [(0.9, A)]), (1, 1, 3, [(0.9, A)]), (None, 1, 3, []), (1, None, 3, [])]
    out = track_batch(spark.createDataFrame(rows, IN), QUICK).collect()
    assert sorted((r.frame_idx, r.obj_id, r.late) for r in out if not r.late) == [(0, 0, False), (1, 0, False)]
    assert [(r.frame_idx, r.obj_id) for r in out if r.late] == [(1, None)]
