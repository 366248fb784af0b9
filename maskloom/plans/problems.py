"""Queries p1, p2 and p4 over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators import orphans, shred, skew
from maskloom.shared import table

REFERENCES = [
    orphans.Reference("prediction", "image_id", "image"),
    orphans.Reference("prediction", "category_id", "category"),
    orphans.Reference("annotation", "image_id", "image"),
    orphans.Reference("annotation", "category_id", "category"),
    orphans.Reference("masklet", "video_id", "video"),
    orphans.Reference("masklet", "category_id", "category"),
    orphans.Reference("video_np_pair", "video_id", "video"),
    orphans.Reference("video_np_pair", "category_id", "category"),
]
SIZES = {"prediction": "score", "annotation": "area", "masklet": "CAST(size(segmentations) AS DOUBLE)", "video_np_pair": "CAST(num_masklets AS DOUBLE)"}


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {r.table for r in REFERENCES} | {r.target for r in REFERENCES}
    return orphans.orphan_references({n: table(spark, sf_dir, n) for n in sorted(names)}, REFERENCES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id", "field_name", "reason").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir).select("table_name", "row_id", "field_name", "reason", "seen_at").distinct())


def _keyed(spark: SparkSession, sf_dir: str, with_values: bool = False) -> DataFrame:
    parts = None
    for name, value in SIZES.items():
        columns = [F.lit(name).alias("table_name"), "category_id"]
        if with_values:
            columns += ["id", F.expr(f"CAST(nanvl({value}, NULL) AS DECIMAL(20, 6))").alias("value")]
        part = table(spark, sf_dir, name).select(*columns)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.over_share(_keyed(spark, sf_dir), "table_name", "category_id", 3).select("table_name", "category_id")


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    wanted = [skew.rows("n_rows"), skew.non_null("n_values", value), skew.total("sum_value", value), skew.least("min_value", value), skew.most("max_value", value)]
    per_key = skew.salted_aggregate(_keyed(spark, sf_dir, True), "table_name", "category_id", wanted, distinct=("n_ids", "id"))
    double = {f"{c}_value": F.col(f"{c}_value").cast("double") for c in ("sum", "min", "max")}
    return per_key.withColumns(double).withColumn("avg_value", F.try_divide("sum_value", F.col("n_values").cast("double")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.nested_links(table(spark, sf_dir, "raw_document"))


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos, annotations and segmentations as flat rows with their parents."""
    return shred.nested_tables(table(spark, sf_dir, "raw_document"))


def p4_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without a document, with the reason."""
    return shred.broken_bodies(table(spark, sf_dir, "raw_document"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_summary": p2_summary, "p4_found": p4_found, "p4_tables": p4_tables, "p4_broken": p4_broken}


def _orphan_sql() -> str:
    tables = dict.fromkeys(r.table for r in REFERENCES)
    once = {t: f"SELECT id, {', '.join(r.field for r in REFERENCES if r.table == t)}, min(delivered_at) AS seen_at FROM {t} GROUP BY ALL" for t in tables}
    refs = " UNION ALL ".join(f"SELECT '{r.table}' AS table_name, id AS row_id, '{r.field}' AS field_name, '{r.target}' AS target, {r.field} AS key, seen_at FROM once_{r.table} WHERE {r.field} IS NOT NULL" for r in REFERENCES)
    targets = " UNION ALL ".join(f"SELECT '{t}' AS target, id AS key, min(delivered_at) AS arrived_at, min(deleted_at) AS gone_at FROM {t} WHERE id IS NOT NULL GROUP BY id" for t in dict.fromkeys(r.target for r in REFERENCES))
    return f"""WITH {", ".join(f"once_{t} AS ({s})" for t, s in once.items())}, refs AS ({refs}), targets AS ({targets}),
    found AS (SELECT DISTINCT table_name, row_id, field_name, seen_at,
      CASE WHEN t.key IS NULL THEN 'missing' WHEN gone_at <= seen_at THEN 'deleted' WHEN arrived_at > seen_at THEN 'late' END AS reason
      FROM refs r LEFT JOIN targets t ON r.target = t.target AND r.key = t.key)"""


def _keyed_sql() -> str:
    value = {"prediction": "score", "annotation": "area", "masklet": "len(segmentations)", "video_np_pair": "num_masklets"}
    return "WITH k AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, category_id, id, CAST(CASE WHEN isnan(CAST({v} AS DOUBLE)) THEN NULL ELSE {v} END AS DECIMAL(20, 6)) AS value FROM {t}" for t, v in value.items()
    ) + ")"


SQL = {
    "p4_broken": r"SELECT record_id, reason FROM (SELECT record_id, CASE WHEN body IS NULL THEN 'null' WHEN trim(body, E' \t\n\r') = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'broken' END AS reason FROM raw_document) WHERE reason IS NOT NULL",
    "p1_found": f"{_orphan_sql()} SELECT DISTINCT table_name, row_id, field_name, reason FROM found WHERE reason IS NOT NULL",
    "p1_report": f"{_orphan_sql()} SELECT table_name, field_name, strftime(seen_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": f"{_keyed_sql()} SELECT table_name, category_id FROM (SELECT table_name, category_id, count(*) AS n FROM k GROUP BY table_name, category_id) JOIN (SELECT table_name, count(*) AS n_all FROM k GROUP BY table_name) USING (table_name) WHERE category_id IS NOT NULL AND n * 100 >= 3 * n_all",
    "p2_summary": f"""{_keyed_sql()} SELECT table_name, category_id, count(*) AS n_rows, count(value) AS n_values, CAST(sum(value) AS DOUBLE) AS sum_value,
      CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value, count(DISTINCT id) AS n_ids,
      CAST(sum(value) AS DOUBLE) / nullif(count(value), 0) AS avg_value FROM k GROUP BY table_name, category_id""",
}
