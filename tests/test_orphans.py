import datetime as dt

from maskloom.operators.orphans import Reference, dictionary_encode, orphan_references, orphan_report

T = lambda d, h=0: dt.datetime(2025, 1, d, h)
ROWS = "id BIGINT, ref BIGINT, delivered_at TIMESTAMP, reason STRING, period INT"
TARGETS = "id BIGINT, delivered_at TIMESTAMP, deleted_at TIMESTAMP, key STRING"
REF = [Reference("rows", "ref", "targets")]


def found(spark, rows, targets):
    tables = {"rows": spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS), "targets": spark.createDataFrame([(*t, "k") for t in targets], TARGETS)}
    return {(r.row_id, r.key, r.reason) for r in orphan_references(tables, REF).collect()}


def test_reasons_at_the_edges(spark):
    targets = [(1, T(1), None), (1, T(9), T(8)), (-5, T(3, 5), None), (64, T(1), T(3)), (None, T(1), None), (2**62, None, None)]
    rows = [
        (10, 1, T(1)), (11, 1, T(8)), (12, 1, T(7, 23)),  # deleted at the very time counts
        (13, -5, T(3, 4)), (14, -5, T(3, 5)), (15, -5, T(4)),  # late only before the arrival
        (16, 63, T(5)), (17, 64, T(3)), (18, 64, T(2)), (19, None, T(2)),
        (20, 2**62, T(1)), (21, 2**62 + 1, None), (22, 1, None),
        (23, 1, T(7)), (23, 1, T(20)),  # a later copy does not count
    ]
    assert found(spark, rows, targets) == {(11, 1, "deleted"), (13, -5, "late"), (16, 63, "missing"), (17, 64, "deleted"), (21, 2**62 + 1, "missing")}


def test_empty_tables_and_null_ids(spark):
    assert found(spark, [], [(1, T(1), None)]) == set()
    assert found(spark, [(None, 7, T(1)), (None, 7, T(2)), (1, 7, T(1))], []) == {(None, 7, "missing"), (1, 7, "missing")}


def test_hot_key_and_report(spark):
    n = 3000
    rows = spark.range(n).selectExpr("id", "IF(id % 3 = 0, 5, id) AS ref", "TIMESTAMP'2025-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 70 AS INT)) AS delivered_at")
    tables = {"rows": rows, "targets": spark.createDataFrame([(1, T(1), None, "")], TARGETS)}
    out = orphan_references(tables, REF)
    assert out.count() == n - 1
    report = {r.month: r.n_orphans for r in orphan_report(out).collect()}
    assert sum(report.values()) == n - 1 and set(report) == {"2025-01", "2025-02", "2025-03"}


def test_dictionary_has_one_code_a_key(spark):
    codes = dictionary_encode(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k STRING"), "k").collect()
    assert len(codes) == 2 == len({c.code for c in codes})


def test_text_keys(spark):
    targets = spark.createDataFrame([("a", T(1), None), ("b", T(5), None), ("c", T(1), T(3)), (None, T(1), None)], "id STRING, delivered_at TIMESTAMP, deleted_at TIMESTAMP")
    rows = spark.createDataFrame([(1, "a", T(2)), (2, "b", T(2)), (3, "c", T(4)), (4, "x", T(2)), (5, None, T(2)), (6, "007", T(2))], "id BIGINT, ref STRING, delivered_at TIMESTAMP")
    numbers = spark.createDataFrame([(7, T(1), None)], "id BIGINT, delivered_at TIMESTAMP, deleted_at TIMESTAMP")
    more = spark.createDataFrame([(8, 7, T(2)), (9, 6, T(2))], "id BIGINT, ref BIGINT, delivered_at TIMESTAMP")
    references = [*REF, Reference("more", "ref", "numbers")]
    out = orphan_references({"rows": rows, "targets": targets, "more": more, "numbers": numbers}, references).collect()
    assert {(r.row_id, r.key, r.reason) for r in out} == {(2, "b", "late"), (3, "c", "deleted"), (4, "x", "missing"), (6, "007", "missing"), (9, "6", "missing")}
