"""Delimited text, JSON lines, media files, and writers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(line: str, among: str = ", ;\t|") -> str:
    """The delimiter of a text line."""
    try:
        return csv.Sniffer().sniff(line, among).delimiter
    except csv.Error:
        return ","


def read_mot(spark: SparkSession, path: str | list[str], columns: list[str], delimiter: str | None = None, time: str = "t", key: str = "id") -> DataFrame:
    """Delimited rows of a tracking text file: ``columns`` as strings, ``time`` and ``key`` as numbers.

    Without ``delimiter`` it is sniffed from the first line. Lines with fewer fields have nulls. A row whose
    time or key is no number is an error.
    """
    if delimiter is None:
        first = spark.read.text(path).where(F.length("value") > 0).head(1)
        delimiter = sniff(first[0][0]) if first else ","
    raw = spark.read.csv(path, sep=delimiter, schema=", ".join(f"`{c}` STRING" for c in columns), mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    whole = lambda c: F.col(c).cast("double").cast("long")
    return raw.withColumns({time: whole(time), key: whole(key)})


def mot_rows(rows: DataFrame, valid: dict[str, list[str]] | None = None, ignored: dict[str, list[str]] | None = None, convert: dict[str, dict[str, str]] | None = None, drop_negative: bool = False, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(data, ignore regions). A row in the ignore lists is in the second only. ``valid`` keeps rows whose values
    are all in the lists; ``convert`` maps values first, unknown ones to null; ``drop_negative`` drops ids < 0. The case
    of letters doesn't matter for the lists, nor for what ``convert`` maps."""
    within = lambda column, values: F.lower(F.col(column)).isin([v.lower() for v in values])
    for column, mapping in (convert or {}).items():
        pairs = [F.lit(x) for k, v in mapping.items() for x in (k.lower(), v)]
        rows = rows.withColumn(column, F.try_element_at(F.create_map(*pairs), F.lower(F.col(column))))
    skip: Column = F.lit(False)
    if ignored:
        skip = F.lit(True)
        for column, values in ignored.items():
            skip = skip & F.coalesce(within(column, values), F.lit(False))
    data = rows.where(~skip)
    for column, values in (valid or {}).items():
        data = data.where(within(column, values))
    if drop_negative:
        data = data.where(F.col(key) >= 0)
    return data, rows.where(skip) if ignored else rows.limit(0)


def last_json_rows(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The last line of each JSON lines file, parsed: file and its fields. Lines are told apart by their place:
    a file is read as one text, so this is for log files, not for data."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    last = F.element_at(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != ""), -1)
    return docs.where(F.trim("value") != "").select("file", F.from_json(last, schema).alias("v")).select("file", "v.*")


def find_files(spark: SparkSession, path: str, name: str, exclude: str | None = None) -> DataFrame:
    """Files of a name pattern below a folder, without paths that contain ``exclude``: file, length, modified."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    found = found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    return found.where(~F.col("file").contains(exclude)) if exclude else found


def collect_stats(spark: SparkSession, paths: list[str], schema: str, level: int = 2) -> DataFrame:
    """Rows of one JSON object a file, with ``dataset``: the folder ``level`` above the file."""
    docs = spark.read.schema(schema).option("multiLine", True).json(paths)
    return docs.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -level).alias("dataset"), "*")


def parameters(text: str) -> dict[str, str]:
    """Scalars of simple ``key: value`` configuration text by dotted path; a driver-side helper."""
    out, stack = {}, []
    for line in text.splitlines():
        if not (body := line.split("#")[0].rstrip()):
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            out[".".join([k for _, k in stack] + [key])] = value.strip().strip("'\"")
        else:
            stack.append((depth, key))
    return out


def clip(clips: DataFrame, key: str) -> dict:
    """The one row of a clip table; none or several are an error."""
    rows = clips.where(F.col("clip_id") == key).take(2)
    if len(rows) != 1:
        raise ValueError(f"{key}: {'no row' if not rows else 'several rows'}")
    return rows[0].asDict()


def media(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Paths of frames below a folder, by video (the file's folder) in order of name; contents aren't read."""
    f = find_files(spark, path, pattern).select("file", F.element_at(F.split("file", "/"), -2).alias("video"))
    return f.groupBy("video").agg(F.array_sort(F.collect_list("file")).alias("frames"))  # a video's frames


def rounded_results(rows: DataFrame, digits: int = 5) -> DataFrame:
    """Result rows as written: boxes, scores and areas rounded half to even."""
    changes = {}
    if "bbox" in rows.columns:
        changes["bbox"] = F.transform("bbox", lambda v: F.bround(v, digits))
    changes |= {c: F.bround(c, digits) for c in ("score", "area") if c in rows.columns}
    return rows.withColumns(changes)


def write_results(rows: DataFrame, path: str, keep_boxes: bool = True) -> None:
    """Result rows as JSON lines, one file a partition."""
    (rounded_results(rows) if keep_boxes else rounded_results(rows).drop("bbox")).write.mode("error").json(path)


def write_metrics(dataset: DataFrame, per_pair: DataFrame, path: str) -> None:
    """Dataset metrics in long form and metrics per pair, as two tables."""
    dataset.write.mode("error").parquet(f"{path}/dataset_results")
    per_pair.write.mode("error").parquet(f"{path}/pair_results")


SUMMARY = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA", "OWTA", "HOTA_0", "LocA_0", "HOTALocA_0"]


def write_summary(final: DataFrame, path: str) -> None:
    """Tracking metrics, blank separated with a header, in the fixed order, in percent to five digits."""
    own = [c for c in SUMMARY if c in final.columns]
    final.select(*(F.format_string("%.5g", F.col(c) * 100).alias(c) for c in own)).coalesce(1).write.mode("error").csv(path, sep=" ", header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep=" ", header=True)
    return raw.select(*(F.col(c).cast("double").alias(c) for c in raw.columns))


def append_scalars(metrics: DataFrame, step: int, path: str) -> None:
    """metric, value rows appended to a log table, partitioned by step."""
    metrics.select(F.lit(step).alias("step"), "metric", "value").write.mode("append").partitionBy("step").parquet(path)


def dashboard(log: DataFrame) -> DataFrame:
    """Steps as rows, metrics as columns."""
    return log.groupBy("step").pivot("metric").agg(F.first("value")).orderBy("step")
