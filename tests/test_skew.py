from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskloom.operators import skew

SCHEMA = "g STRING, k BIGINT, v DOUBLE, n_rows INT, _salt STRING"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_same_as_plain_aggregation(spark):
    rows = [("a", 1 if i % 3 else (None if i % 2 else i), None if i % 11 == 0 else float(i % 17)) for i in range(2000)] + [("b", 5, 1.0)] * 7
    df = frame(spark, rows)
    wanted = [skew.rows("n"), skew.non_null("nv", F.col("v")), skew.total("s", F.col("v")), skew.least("lo", F.col("v")), skew.most("hi", F.col("v"))]
    got = {(r.g, r.k): tuple(r)[2:] for r in skew.salted_aggregate(df, "g", "k", wanted, distinct=("d", "v")).collect()}
    plain = df.groupBy("g", "k").agg(F.count("*"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.count_distinct("v")).collect()
    assert got == {(r[0], r[1]): tuple(r)[2:] for r in plain}


def test_shares_count_nulls_and_ties(spark):
    rows = [("a", 1, 0.0)] * 3 + [("a", 2, 0.0)] * 3 + [("a", None, 0.0)] * 94 + [("b", 9, 0.0)]
    got = Counter((r.g, r.k) for r in skew.over_share(frame(spark, rows), "g", "k", 3).collect())
    assert got == Counter([("a", 1), ("a", 2), ("b", 9)])


def test_empty(spark):
    df = frame(spark, [])
    assert skew.over_share(df, "g", "k", 3).count() == 0
    assert skew.salted_aggregate(df, "g", "k", [skew.rows("n")], distinct=("d", "v")).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "g", "k", 0.0001)
