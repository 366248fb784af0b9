import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskloom.functions import runs as R
from maskloom.plans import registry

SQL = registry.SQL


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(registry.QUERIES) <= set(names)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted("|".join(map(normal, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        own = [d[0] for d in result.description]
        assert sorted(own) == columns
        at = [own.index(c) for c in columns]
        assert rows == sorted("|".join(normal(r[i]) for i in at) for r in result.fetchall())


def rows_of(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


def test_tracker_as_stream_and_as_batch(spark, sf):
    own, other = ({(r.video_id, r.frame_idx, r.obj_id, r.score, tuple(r.box or ())) for r in rows_of(spark, sf, n)} for n in ("tracker_batch", "tracker_stream"))
    assert own == other and len(own) > 100


def test_queries_are_capped_and_replaced(spark, sf):
    texts = {}
    for r in spark.read.parquet(f"{sf}/datapoint.parquet").select("datapoint_id", "find_queries").collect():
        texts[r.datapoint_id] = [q.query_text for q in r.find_queries or []]
    capped = rows_of(spark, sf, "capped_queries")
    assert {r.datapoint_id for r in capped} == set(texts)
    for r in capped:
        rest = iter(texts[r.datapoint_id])
        assert len(r.texts) == min(2, len(texts[r.datapoint_id])) and all(t in rest for t in r.texts)  # in their order
    for r in rows_of(spark, sf, "visual_queries"):
        own = [q.text for q in r.queries or []]
        assert len(own) == len(texts[r.datapoint_id])
        assert all(a == b or (a == "visual" and q.boxes) for a, b, q in zip(own, texts[r.datapoint_id], r.queries or [], strict=True))


def test_masks_put_together_and_apart(spark, sf):
    union = {r.id: r.area for r in rows_of(spark, sf, "mask_union")}
    for r in rows_of(spark, sf, "mask_track_sizes"):
        assert r.largest <= union[r.id] <= r.largest * r.n
    kept = {}
    for r in rows_of(spark, sf, "masks_without_overlap"):
        kept.setdefault((r.video_id, r.frame), []).append(r.area)
    m = spark.read.parquet(f"{sf}/masklet.parquet").dropDuplicates(["id"]).where("video_id IS NOT NULL AND id IS NOT NULL")
    frames = m.selectExpr("video_id", "posexplode(segmentations) AS (frame, mask)").where("mask IS NOT NULL").groupBy("video_id", "frame").agg(F.collect_list("mask").alias("masks"))
    want = {(r.video_id, r.frame): r.area for r in frames.select("video_id", "frame", R.mask_area(R.union_masks(F.col("masks"))).alias("area")).collect()}
    assert {k: sum(v) for k, v in kept.items()} == want  # each pixel of the union stays with one mask


def test_suppressed_masks_hardly_meet(spark, sf):
    rows = rows_of(spark, sf, "mask_nms")
    assert any(r.iou for r in rows) and all(r.iou or r.iom for r in rows)
    m = {r.id: r.segmentations for r in spark.read.parquet(f"{sf}/masklet.parquet").select("id", "segmentations").dropDuplicates(["id"]).collect()}
    per = {}
    for r in rows:
        if r.iou:
            per.setdefault((r.video_id, r.frame), []).append(m[r.id][r.frame])
    for masks in list(per.values())[:200]:
        for k in range(len(masks) - 1):
            a, b = ([masks[i].counts for i in (k, k + 1)], [masks[i].size for i in (k, k + 1)])
            one = R.Runs.parse(a[:1], b[:1]), R.Runs.parse(a[1:], b[1:])
            common, _ = one[0].intersections(one[1])
            assert common[0] <= 0.3 * (one[0].areas()[0] + one[1].areas()[0] - common[0]) + 1e-9
