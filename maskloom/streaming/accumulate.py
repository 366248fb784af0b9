"""Metrics that grow with a stream: counters per key, merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.shared import delete, materialize


class Accumulator:
    """Sums of counters in a folder, one partition of partial sums per micro-batch.

    ``update`` writes the batch's own sums as partition ``batch``; a batch that is run again replaces its
    partition, so counters are exact after a failure. ``current`` adds the partitions up; ``compact`` puts all
    but the last into one, ``reset`` drops everything.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], counters: list[str]):
        self.spark, self.folder, self.keys, self.counters = spark, folder, keys, counters

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.counters))

    def update(self, batch: DataFrame, number: int) -> None:
        self._sums(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def sink(self, per_unit: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: rows become counters, which are merged."""
        return lambda batch, number: self.update(per_unit(batch), number)

    def current(self) -> DataFrame:
        return self._sums(self.spark.read.parquet(self.folder))

    def compact(self) -> None:
        rows = self.spark.read.parquet(self.folder)
        last = rows.agg(F.max("batch").alias("b")).first()["b"]
        merged = self._sums(rows.where(F.col("batch") < last)).withColumn("batch", F.lit(last - 1))
        keep = merged.unionByName(rows.where(F.col("batch") == last).select(*merged.columns))
        materialize(keep, "counters").write.mode("overwrite").partitionBy("batch").parquet(self.folder)

    def reset(self) -> None:
        delete(self.spark, self.folder)
