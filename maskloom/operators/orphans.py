"""References to records that do not exist (yet, or any more).

Keys are integers: BIGINT keys are their own code, others go through ``dictionary_encode``. A bitmap
covers one period (a day) and one range of 64 keys; it is one BIGINT, ranges without a set bit have no
row at all, so sparse key spaces cost nothing and dense ones one bit a key. Bitmaps of references are
combined before the shuffle (``bit_or`` in a hash aggregate), as are those of the targets' arrivals and
deletions. Per range, one window over the periods turns arrivals and deletions into the targets that
exist throughout a period, and ``references AND NOT existing`` leaves the bits in doubt. They are
decoded; rows of the decoded (key, period) are compared with the exact times.

A hot key is one bit a period, however many rows refer to it; in the exact comparison its rows are
spread over the periods, and the adaptive skew join splits what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from maskloom.shared import materialize

ALWAYS = -1_000_000  #: the period of a missing time: before every other


@dataclass(frozen=True)
class Reference:
    """``field`` of ``table`` refers to ``id`` of the table ``target``."""

    table: str
    field: str
    target: str


def dictionary_encode(keys: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values of ``key`` with an integer ``code``, for keys that aren't integers. Codes
    of one sorted partition are consecutive, so the bitmaps over them are dense. Written once: codes
    must not change between uses."""
    spread = keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key)
    return materialize(spread.sortWithinPartitions(key).withColumn("code", F.monotonically_increasing_id()), "dictionary")


def period_of(at: Column) -> Column:
    """Days since 1970."""
    return F.coalesce(F.datediff(at, F.lit("1970-01-01").cast("date")), F.lit(ALWAYS))


def first_deliveries(rows: DataFrame, table: str, refs: list[Reference], kind: str = "long") -> DataFrame:
    """One row per (id, references) with the first delivery, then one per non-null reference:
    table_name, row_id, field_name, target, key, seen_at. Copies are combined before the shuffle."""
    fields = [r.field for r in refs]
    once = rows.groupBy("id", *fields).agg(F.min("delivered_at").alias("seen_at"))
    per_field = F.array(*(F.struct(F.lit(r.field).alias("field_name"), F.lit(r.target).alias("target"), F.col(r.field).cast(kind).alias("key")) for r in refs))
    flat = once.select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "seen_at", F.inline(per_field))
    return flat.where(F.col("key").isNotNull())


def target_times(rows: DataFrame, target: str, kind: str = "long") -> DataFrame:
    """target, key, arrived_at (first delivery), gone_at (smallest deleted_at of any delivery)."""
    ids = rows.where(F.col("id").isNotNull()).groupBy(F.col("id").cast(kind).alias("key"))
    times = ids.agg(F.min("delivered_at").alias("arrived_at"), F.min("deleted_at").alias("gone_at"))
    return times.select(F.lit(target).alias("target"), "key", "arrived_at", "gone_at")


def bitmap(rows: DataFrame, by: list[str], period: Column, name: str) -> DataFrame:
    """``by``, period, key_range and the bits of the keys: bit ``key & 63`` of range ``key >> 6``."""
    bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    return rows.groupBy(*by, F.shiftright("key", 6).alias("key_range"), period.alias("period")).agg(F.bit_or(bit).alias(name))


def bits(word: Column) -> Column:
    """Positions of the set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1)


def in_doubt(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References AND NOT existing targets: target, key, period of the bits that are left. A target
    exists throughout a period if it arrived in an earlier one and is not deleted by the period's end."""
    zero = F.lit(0).cast("long")
    asked = bitmap(refs, ["target"], period_of(F.col("seen_at")), "asked").withColumns({"arrived": zero, "gone": zero})
    came = bitmap(targets, ["target"], period_of(F.col("arrived_at")), "arrived").withColumns({"asked": zero, "gone": zero})
    went = bitmap(targets.where(F.col("gone_at").isNotNull()), ["target"], period_of(F.col("gone_at")), "gone").withColumns({"asked": zero, "arrived": zero})
    line = Window.partitionBy("target", "key_range").orderBy("period")
    present = F.coalesce(F.bit_or("arrived").over(line.rangeBetween(Window.unboundedPreceding, -1)), zero)
    absent = F.coalesce(F.bit_or("gone").over(line.rangeBetween(Window.unboundedPreceding, 0)), zero)
    joined = asked.unionByName(came).unionByName(went).withColumn("exists", present.bitwiseAND(F.bitwise_not(absent)))
    left = joined.select("target", "key_range", "period", F.col("asked").bitwiseAND(F.bitwise_not("exists")).alias("left")).where("left <> 0")
    decoded = left.select("target", "period", "key_range", F.explode(bits(F.col("left"))).alias("bit"))
    return decoded.select("target", "period", (F.shiftleft("key_range", 6) + F.col("bit")).alias("key"))


def integer_keys(tables: dict[str, DataFrame], references: list[Reference]) -> bool:
    used = {(r.table, r.field) for r in references} | {(r.target, "id") for r in references}
    return all(isinstance(tables[t].schema[c].dataType, IntegralType) for t, c in used)


def key_codes(refs: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """target, key, code: a dictionary for each target."""
    out = None
    for name in names:
        keys = refs.where(F.col("target") == name).select("key").unionByName(targets.where(F.col("target") == name).select("key"))
        own = dictionary_encode(keys, "key").select(F.lit(name).alias("target"), "key", "code")
        out = own if out is None else out.unionByName(own)
    return out


def coded(rows: DataFrame, codes: DataFrame) -> DataFrame:
    return rows.join(codes, ["target", "key"]).drop("key").withColumnRenamed("code", "key")


def orphan_references(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """Every reference to a record that is missing, deleted or late: table_name, row_id, field_name, key,
    seen_at, reason.

    ``tables`` need ``id``, ``delivered_at`` and the referring fields, targets also ``deleted_at``; other
    columns are ignored, so their names can't clash. Defined cases: a null reference is no reference; a
    null target id is no record; copies of a row count once with the first delivery, ids delivered with
    differing references once per reference; a null id is an id like any other; a row without a time can
    only be ``missing``, a target without one is never ``late``. Empty tables give no rows, or all
    references as ``missing``. ``missing`` goes before ``deleted`` before ``late``. If any key isn't an
    integer, all are compared as text by the codes of a dictionary, and ``key`` is that text.
    """
    plain = integer_keys(tables, references)
    kind = "long" if plain else "string"
    by_table: dict[str, list[Reference]] = {}
    for r in references:
        by_table.setdefault(r.table, []).append(r)
    refs = targets = None
    for name, own in by_table.items():
        part = first_deliveries(tables[name], name, own, kind)
        refs = part if refs is None else refs.unionByName(part)
    names = list(dict.fromkeys(r.target for r in references))
    for name in names:
        part = target_times(tables[name], name, kind)
        targets = part if targets is None else targets.unionByName(part)
    if not plain:
        codes = key_codes(refs, targets, names)
        refs, targets = coded(refs, codes), coded(targets, codes)
    doubt = in_doubt(refs, targets).join(targets.withColumn("known", F.lit(True)), ["target", "key"], "left")
    rows = refs.withColumn("period", period_of(F.col("seen_at"))).join(doubt, ["target", "key", "period"])
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("gone_at") <= F.col("seen_at"), "deleted")
        .when(F.col("arrived_at") > F.col("seen_at"), "late")
    )
    if not plain:
        rows = rows.join(codes.withColumnsRenamed({"key": "text", "code": "key"}), ["target", "key"]).withColumn("key", F.col("text"))
    found = rows.select("table_name", "row_id", "field_name", "key", "seen_at", reason.alias("reason"))
    return found.where(F.col("reason").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month of first delivery (null: no time known)."""
    by = found.groupBy("table_name", "field_name", F.date_format("seen_at", "yyyy-MM").alias("month"), "reason")
    return by.agg(F.count(F.lit(1)).alias("n_orphans"))
