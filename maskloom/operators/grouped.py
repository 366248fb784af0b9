"""Procedural work on many small groups, and copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_copy(df: DataFrame, key: str = "id", at: str = "delivered_at") -> DataFrame:
    """One row per id, the first delivered. The limit is applied in each task before the shuffle; prune
    columns first. Null ids are one id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(at))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partitioned by the keys into as many parts as the session's shuffles have, whatever their size: Python
    work is heavy for its bytes, so its partitions must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def map_groups(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table, list[int]], pa.Table], schema: str, order: list[str] | None = None) -> DataFrame:
    """``kernel`` over many groups at a time: a table of whole groups, each in ``order``, and where they begin and
    end. Groups are streamed from sorted partitions, so a small group costs no more than its rows; a group
    must be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            starts = _starts(held, keys)
            if len(starts) > 1:
                yield from kernel(held.slice(0, starts[-1]), starts).to_batches()
                held = held.slice(starts[-1])
        if held is not None:
            yield from kernel(held, [0, held.num_rows]).to_batches()

    return spread(df, keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of a sorted table begin."""
    if table.num_rows < 2:
        return [0]
    changed = None
    for k in keys:
        c = table.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        changed = differs if changed is None else pc.or_(changed, differs)
    return [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist())]
