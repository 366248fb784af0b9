"""Counts of every term, kept up to date by signed deltas.

The state is a folder: the records' deliveries, appended version by version and partitioned by a hash of the id, the
counts per term, partitioned by a hash of the term, and a row of state, which is written last and so commits a
version. A batch of deliveries is compared with the latest deliveries of its own ids: a new record adds its terms, a
changed one takes its old terms away and adds the new ones, a deleted one takes them away. A delivery older than the
one known changes nothing, whenever it comes, so the counts don't depend on how deliveries are batched or ordered. Only
added, changed and deleted records are read into terms; their signed numbers are summed per term before the shuffle
(so frequent terms are no load) and merged into the partitions of counts that they touch. The log is compacted when
it has many versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.shared import delete, exists, materialize, scratch

TERM = r"[\p{L}\p{N}]+"
BUCKETS = 16  #: partitions of counts and of the log, unless the state has others
COMPACT = 8  #: versions of the log that are read before it is compacted


def terms_of(texts: Column) -> Column:
    """All terms of an array of texts, in order: longest runs of letters and digits in lower case."""
    return F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0))))


def latest(batch: DataFrame) -> DataFrame:
    """id and ``v``, the last delivery (at, deleted, texts) of each id. Of several of one moment a deletion is the last,
    then the greatest texts; one without a time comes before all others."""
    v = F.struct(F.col("delivered_at").alias("at"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "texts")
    return batch.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(v).alias("v"))


def signed_deltas(changes: DataFrame) -> DataFrame:
    """term, d_occurrences, d_records of the rows sign, texts."""
    every = terms_of(F.col("texts"))
    with_terms = changes.select("sign", every.alias("t")).where(F.size("t") > 0)
    sign, zero = F.col("sign").cast("long"), F.lit(0).cast("long")
    one = lambda t: F.struct(t.alias("term"), sign.alias("o"), zero.alias("r"))
    first = lambda t: F.struct(t.alias("term"), zero.alias("o"), sign.alias("r"))
    both = F.concat(F.transform("t", one), F.transform(F.array_distinct("t"), first))
    return with_terms.select(F.inline(both)).groupBy("term").agg(F.sum("o").alias("d_occurrences"), F.sum("r").alias("d_records"))


class TermCounts:
    """Persistent counts; ``apply`` merges a batch, ``counts`` and ``n_records`` read the state. An existing folder is
    taken up where its last committed version ends; what a failed batch left behind is overwritten.

    Defined cases: null ids are no records; null texts, null elements and empty texts have no terms, their
    records still count in ``n_records``; counts that fall to 0 disappear; an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder or scratch(spark, "terms"), buckets
        self.version, self.size = 0, 0
        self.log: list[int] = []  #: versions of the log
        self.at: dict[int, int] = {}  #: version of each bucket of counts
        if exists(spark, f"{self.folder}/state"):
            last = spark.read.parquet(f"{self.folder}/state").orderBy(F.col("version").desc()).first()
            self.version, self.size, self.buckets = last["version"], last["size"], last["buckets"]
            self.log, self.at = list(last["log"]), {int(b): int(v) for b, v in last["counts"].items()}

    def _hashed(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def _touched(self, df: DataFrame) -> list[int]:
        """Buckets of the rows: at most ``buckets`` numbers."""
        return sorted(r["bucket"] for r in df.select("bucket").distinct().collect())

    def _records(self) -> DataFrame:
        paths = [f"{self.folder}/records/version={v}" for v in self.log]
        return self.spark.read.option("basePath", f"{self.folder}/records").parquet(*paths)

    def _known(self, ids: DataFrame) -> DataFrame:
        """_id and _v, the latest deliveries of ``ids`` in the log; only their partitions are read."""
        own = self._records().where(F.col("bucket").isin(self._touched(ids))).join(ids.select("id"), "id", "left_semi")
        return own.groupBy(F.col("id").alias("_id")).agg(F.max("v").alias("_v"))

    def _write(self, df: DataFrame, table: str, version: int) -> None:
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/version={version}")

    def _commit(self, version: int, size: int, log: list[int], at: dict[int, int]) -> None:
        row = self.spark.range(1).select(
            F.lit(version).alias("number"), F.lit(size).cast("long").alias("size"), F.lit(self.buckets).alias("buckets"), F.array(*map(F.lit, log)).cast("array<int>").alias("log"),
            F.map_from_arrays(F.array(*map(F.lit, at)).cast("array<int>"), F.array(*map(F.lit, at.values())).cast("array<int>")).alias("counts"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/version={version}")
        self.version, self.size, self.log, self.at = version, size, log, at

    def apply(self, batch: DataFrame) -> None:
        """``batch``: id, texts ARRAY<STRING>, deleted BOOLEAN, delivered_at."""
        to = self.version + 1
        new = materialize(latest(batch).withColumn("bucket", self._hashed("id")), "batch")
        if self.log:
            both = new.join(self._known(new), F.col("id") == F.col("_id"), "left")
        else:
            both = new.withColumn("_v", F.lit(None).cast(new.schema["v"].dataType))
        newer = materialize(both.where(F.col("_v").isNull() | (F.col("v") > F.col("_v"))).select("id", "v", "_v", "bucket"), "newer")
        self._write(newer.select("id", "v", "bucket"), "records", to)
        was, is_ = F.coalesce(~F.col("_v.deleted"), F.lit(False)), ~F.col("v.deleted")
        other = ~(was & is_ & F.col("v.texts").eqNullSafe(F.col("_v.texts")))
        side = lambda sign, texts: F.struct(F.lit(sign).alias("sign"), texts.alias("texts"))
        signed = F.array(F.when(was & other, side(-1, F.col("_v.texts"))), F.when(is_ & other, side(1, F.col("v.texts"))))
        deltas = signed_deltas(newer.select(F.explode(signed).alias("s")).where("s IS NOT NULL").select("s.sign", "s.texts")).where("d_occurrences <> 0 OR d_records <> 0")
        deltas = materialize(deltas.withColumn("bucket", self._hashed("term")), "deltas")
        touched = self._touched(deltas)
        summed = deltas.select("bucket", "term", F.col("d_occurrences").alias("n_occurrences"), F.col("d_records").alias("n_records"))
        if old := [b for b in touched if b in self.at]:
            summed = summed.unionByName(self._read({b: self.at[b] for b in old})).groupBy("bucket", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
        self._write(summed.where("n_records <> 0 OR n_occurrences <> 0"), "counts", to)
        at = {b: v for b, v in self.at.items() if b not in touched}
        at |= {b: to for b in touched if exists(self.spark, f"{self.folder}/counts/version={to}/bucket={b}")}
        grown = newer.agg(F.sum(F.when(is_, 1).otherwise(0) - F.when(was, 1).otherwise(0)).alias("n")).first()["n"] or 0
        log = [*self.log, to] if exists(self.spark, f"{self.folder}/records/version={to}/_SUCCESS") and newer.head(1) else self.log
        before = dict(self.at)
        self._commit(to, self.size + grown, log, at)
        for b in old:
            delete(self.spark, f"{self.folder}/counts/version={before[b]}/bucket={b}")
        if len(self.log) > COMPACT:
            self.compact()

    def compact(self) -> None:
        """One version of the log, with the latest delivery of each id."""
        to, before = self.version + 1, self.log
        self._write(self._records().groupBy("id", "bucket").agg(F.max("v").alias("v")), "records", to)
        self._commit(to, self.size, [to], self.at)
        for v in before:
            delete(self.spark, f"{self.folder}/records/version={v}")

    def _read(self, at: dict[int, int]) -> DataFrame:
        schema = "term STRING, n_occurrences BIGINT, n_records BIGINT, bucket INT"
        if not at:
            return self.spark.createDataFrame([], schema).select("bucket", "term", "n_occurrences", "n_records")
        paths = [f"{self.folder}/counts/version={v}/bucket={b}" for b, v in at.items()]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/counts").parquet(*paths).select("bucket", "term", "n_occurrences", "n_records")

    def counts(self) -> DataFrame:
        """bucket, term, n_occurrences, n_records."""
        return self._read(self.at)

    def n_records(self) -> int:
        return self.size

    def marked(self, rare: int = 2, common: tuple[int, int] = (1, 5)) -> DataFrame:
        """Counts with a mark: ``rare`` in at most so many records, ``common`` in more than that share of all
        records (those without terms included), else null."""
        many = F.col("n_records") * common[1] > F.lit(self.size * common[0])
        mark = F.when(F.col("n_records") <= rare, "rare").when(many, "common")
        return self.counts().select("term", "n_occurrences", "n_records", mark.alias("mark"))
