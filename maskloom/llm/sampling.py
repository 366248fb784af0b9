"""A sample with given shares per stratum, from mergeable reservoirs.

Every id has a priority, the first 60 bits of an MD5 of seed and id. In one pass each task keeps, per stratum, a
reservoir of the ids with the smallest priorities: as many as its part of the ids can be expected to give to the
sample, and a margin; the rest is counted and thrown away, and the smallest priority thrown away is its limit.
Reservoirs merge by union, with the smallest limit, and counts add up. When the final counts are known, the merged
reservoir is cut to the stratum's feasible quota: all bands of priorities before the one in which the quota ends,
and of that band the first ids by (priority, id). Should a quota not be covered below the limit, the pass is made
again with wider margins, so the sample is always the one of unbounded reservoirs. Priorities depend on nothing
but seed and id, so each stratum's sample is uniform, and the same however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.shared import materialize

BAND_BITS = 12  #: 2 ** 12 bands a stratum; only one of them is ever ranked
MAX_TARGETS = 1_000_000  #: rows of a target table that may be broadcast; larger ones are refused
HELD = 1 << 20  #: ids a task holds before it trims its reservoirs
NO_LIMIT = 1 << 60  #: beyond every priority


def priority(key: Column, seed: int) -> Column:
    """60 bits as BIGINT, from the first 15 hexadecimal digits of md5('seed:id')."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


class Reservoirs:
    """The reservoirs of one task."""

    def __init__(self, rate: tuple[int, int], margin: float, held: int):
        self.rate, self.margin, self.held = rate, margin, held
        self.seen = 0  #: ids of all strata
        self.counts: dict[int, int] = {}
        self.limits: dict[int, int] = {}
        self.columns = [np.zeros(0, np.int64) for _ in range(5)]  # stratum, priority, id, share_permille, min_rows
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, columns: list[np.ndarray], seen: int) -> None:
        self.seen += seen
        for s, n in zip(*(x.tolist() for x in np.unique(columns[0], return_counts=True)), strict=True):
            self.counts[s] = self.counts.get(s, 0) + n
        self.waiting.append(columns)
        self.size += len(columns[0])
        if self.size > 2 * self.held:
            self.trim()

    def trim(self) -> None:
        """Keep the best of each stratum: what ``seen`` ids give to the sample, by the stratum's share or minimum, and
        a margin of some standard deviations."""
        c = [np.concatenate([a, *more]) for a, more in zip(self.columns, zip(*self.waiting, strict=True), strict=True)] if self.waiting else self.columns
        order = np.lexsort((c[2], c[1], c[0]))
        stratum, own, ids, share, least = (x[order] for x in c)
        first = np.flatnonzero(np.concatenate([[True], stratum[1:] != stratum[:-1]])) if len(stratum) else np.zeros(0, np.int64)
        rank = np.arange(len(stratum)) - np.repeat(first, np.diff(np.concatenate([first, [len(stratum)]])))
        expected = share / 1000 * (self.seen * self.rate[0] / self.rate[1])
        most = np.maximum(least, np.ceil(expected)) + self.margin * (np.sqrt(expected) + 16)
        keep = rank < most
        for s, p in zip(stratum[~keep][::-1].tolist(), own[~keep][::-1].tolist(), strict=True):
            self.limits[s] = min(p, self.limits.get(s, NO_LIMIT))
        self.columns = [x[keep] for x in (stratum, own, ids, share, least)]
        self.waiting, self.size = [], int(keep.sum())


def _reservoirs(rate: tuple[int, int], margin: float, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows id, stratum, priority, share_permille, min_rows (null: no target) to (stratum, id, priority) of what is kept and
    (stratum, null, limit, n) of each stratum, stratum null for all ids without a target."""

    def out(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], names=["stratum", "id", "priority", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = Reservoirs(rate, margin, held), 0
        for b in batches:
            known = b.filter(b.column("share_permille").is_valid())
            other += b.num_rows - known.num_rows
            own.add([known.column(c).to_numpy(zero_copy_only=False) for c in ("stratum", "priority", "id", "share_permille", "min_rows")], b.num_rows)
        own.trim()
        stratum, priorities, ids = own.columns[:3]
        for at in range(0, len(ids), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield out(pa.array(stratum[part]), pa.array(ids[part]), pa.array(priorities[part]), pa.nulls(len(ids[part])))
        strata = [*own.counts, None]
        yield out(pa.array(strata, pa.int64()), pa.nulls(len(strata)), pa.array([own.limits.get(s, NO_LIMIT) for s in strata]), pa.array([*own.counts.values(), other]))

    return run


class StratifiedSample:
    """``report`` tells per stratum what was wanted, what there is and what was drawn, ``sample`` is the trimmed sample.

    ``rows`` has id and stratum. Copies of an id count once (with its smallest stratum, should they differ);
    ids without a stratum, or of one that isn't in ``targets``, count for the size of the whole, not for the
    sample; null ids are no ids. ``targets`` has stratum, share_permille and min_rows (null: 0), one row
    each; repeated rows of a stratum count once, with the largest values. Strata without ids are reported
    with 0 available. The sample has ``n_ids * rate[0] // rate[1]`` rows before the minimums; a stratum wants
    its share of that, rounded up, but at least its minimum. ``margin`` is the first margin of the reservoirs in
    standard deviations; it changes what tasks hold, not the sample.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, rate: tuple[int, int] = (1, 10), seed: int = 17, margin: float = 5.0, held: int = HELD):
        wanted = targets.where(F.col("stratum").isNotNull()).groupBy(F.col("stratum").cast("long").alias("stratum"))
        self.targets = wanted.agg(F.coalesce(F.max("share_permille"), F.lit(0)).cast("long").alias("share_permille"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("long").alias("min_rows"))
        if (n := self.targets.count()) > MAX_TARGETS:
            raise ValueError(f"{n} strata in targets; at most {MAX_TARGETS}")
        once = rows.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("long").alias("id")).agg(F.min("stratum").cast("long").alias("stratum"))
        known = once.join(F.broadcast(self.targets), "stratum", "left").select("id", "stratum", priority(F.col("id"), seed).alias("priority"), "share_permille", "min_rows")
        self.passes = 0
        while True:
            self.passes += 1
            kept = materialize(known.mapInArrow(_reservoirs(rate, margin, held), "stratum BIGINT, id BIGINT, priority BIGINT, n BIGINT"), "reservoirs")
            counts = kept.where("n IS NOT NULL")
            self.size = (counts.agg(F.sum("n")).first()[0] or 0) * rate[0] // rate[1]
            self.available = counts.where("stratum IS NOT NULL").groupBy("stratum").agg(F.sum("n").alias("available"), F.min("priority").alias("limit"))
            self.fragments = kept.where("n IS NULL").select("stratum", "id", "priority", F.shiftright("priority", 60 - BAND_BITS).cast("int").alias("band"))
            if self._covered():
                return
            margin = 8 * margin + 8

    @property
    def quotas(self) -> DataFrame:
        """stratum, share_permille, min_rows, limit, wanted, available, quota (feasible); one row a target."""
        share = F.expr(f"(share_permille * {self.size}L + 999) DIV 1000")
        joined = self.targets.join(self.available, "stratum", "left").withColumns({"available": F.coalesce("available", F.lit(0).cast("long")), "wanted": F.greatest(share, "min_rows")})
        return joined.withColumn("quota", F.least("wanted", "available"))

    def _covered(self) -> bool:
        """Whether each stratum's quota lies below the smallest priority that any task threw away."""
        limits = self.quotas.select("stratum", "quota", F.coalesce("limit", F.lit(NO_LIMIT)).alias("limit"))
        below = self.fragments.join(F.broadcast(limits), "stratum").where(F.col("priority") < F.col("limit")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
        return not limits.join(below, "stratum", "left").where(F.coalesce("n", F.lit(0)) < F.col("quota")).head(1)

    @property
    def sample(self) -> DataFrame:
        """stratum, id of the sample."""
        counts = self.fragments.groupBy("stratum", "band").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("stratum").orderBy("band")) - F.col("n")
        cut = counts.withColumn("before", before).join(self.quotas.select("stratum", "quota"), "stratum").where("before < quota AND before + n >= quota")
        cut = cut.select("stratum", F.col("band").alias("cut_band"), (F.col("quota") - F.col("before")).alias("left"))
        near = self.fragments.join(F.broadcast(cut), "stratum").where("band <= cut_band")  # one row a stratum
        rank = F.row_number().over(Window.partitionBy("stratum").orderBy("priority", "id"))
        whole = near.where("band < cut_band").select("stratum", "id")
        part = near.where("band = cut_band").withColumn("rank", rank).where(F.col("rank") <= F.col("left")).select("stratum", "id")
        return whole.unionByName(part)

    @property
    def report(self) -> DataFrame:
        """stratum, share_permille, min_rows, wanted, available, quota (the rows drawn), exhausted."""
        drawn = self.sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("drawn"))
        joined = self.quotas.drop("limit", "quota").join(drawn, "stratum", "left").withColumn("quota", F.coalesce("drawn", F.lit(0).cast("long")))
        return joined.drop("drawn").withColumn("exhausted", F.col("wanted") > F.col("quota"))
