"""Boxes apart in both directions, whose gaps multiply to the sum of their areas."""

import pytest

from maskloom.plans import registry


@pytest.fixture(scope="module")
def apart(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("apart"))
    now = "TIMESTAMP '2025-01-01 00:00:00' AS delivered_at"
    known = {
        "image": f"SELECT 1L AS id, 100 AS width, 100 AS height, {now}",
        "annotation": f"SELECT 2L AS id, 1L AS image_id, array(0.0D, 0.0D, 0.02D, 0.02D) AS bbox, 0 AS iscrowd, 1L AS category_id, {now}",
        "prediction": f"SELECT id, 1L AS image_id, bbox, 0.9D AS score, 1L AS category_id, {now} FROM VALUES (3L, array(4.0D, 6.0D, 2.0D, 2.0D)), (4L, array(0.0D, 0.0D, 2.0D, 2.0D)), (5L, array(0.0D, 0.0D, 2.0D, 1.0D)) AS v(id, bbox)",
    }
    for name, sql in known.items():
        spark.sql(sql).write.parquet(f"{at}/{name}.parquet")
    return at


def test_match_totals(spark, apart):
    assert [tuple(r) for r in registry.QUERIES["match_totals"](spark, apart).collect()] == [(1, 1, 1.0)]


def test_one_to_many(spark, apart):
    assert [(r.image_id, r.det, r.gt) for r in registry.QUERIES["one_to_many"](spark, apart).collect()] == [(1, 4, 2)]


def test_optimal_matches(spark, apart):
    assert [tuple(r) for r in registry.QUERIES["optimal_matches"](spark, apart).collect()] == [(1, 2, 4, 1.0)]
