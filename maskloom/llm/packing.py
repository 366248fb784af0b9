"""Filling fixed-capacity containers, with the sources mixed in given proportions.

Rows are dealt into chunks at random (by hash), so each chunk has the corpus' mixture and no source or key
makes a chunk large. Within a chunk, deficit round-robin over one queue per source fills container after
container: each container credits every source its share of the capacity, the source with the largest
credit that has an item that still fits places its largest such item and pays its size. Credits stay
from container to container.

What a chunk can't fill well, at most ``CARRIED`` containers, is not closed but handed on with the credits:
the next round packs the rests of ``FAN`` chunks together, and so on until one chunk is left. So containers
with much unused space don't add up with the number of chunks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.operators.grouped import spread
from maskloom.shared import materialize

CHUNK_TOKENS = 1 << 20  #: tokens packed together by one task
CHUNK_ROWS = 100_000  #: rows packed together by one task, if they are short
FAN = 64  #: chunks whose rests are packed together in the next round
CARRIED = 16  #: containers a chunk hands on at most
FULL = 0.995  #: containers this full are closed at once
BROADCAST_SOURCES = 20_000  #: more sources than this are joined by shuffling

SCHEMA = "kind STRING, chunk BIGINT, doc_id BIGINT, piece_no INT, start_token BIGINT, n_tokens INT, source STRING, share DOUBLE, credit DOUBLE, container_id BIGINT"


class Queue:
    """The items of one source by size; ``sizes`` has bit n set if there are items of n tokens."""

    __slots__ = ("by_size", "sizes")

    def __init__(self) -> None:
        self.by_size: dict[int, list] = {}
        self.sizes = 0

    def add(self, size: int, item: tuple) -> None:
        self.by_size.setdefault(size, []).append(item)
        self.sizes |= 1 << size

    def largest(self, room: int) -> int:
        """The largest size of at most ``room``, -1 if there is none."""
        return (self.sizes & ((1 << (room + 1)) - 1)).bit_length() - 1

    def take(self, size: int) -> tuple:
        items = self.by_size[size]
        item = items.pop()
        if not items:
            del self.by_size[size]
            self.sizes &= ~(1 << size)
        return item


def fill(queues: dict[str | None, Queue], shares: dict[str | None, float], credit: dict[str | None, float], capacity: int) -> list[tuple[int, list[tuple]]]:
    """(unused tokens, items) of each container; ``credit`` is changed in place."""
    out = []
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    rank = {s: i for i, s in enumerate(names)}
    while active := [s for s in names if queues[s].sizes]:
        total = sum(shares[s] for s in active) or 1.0
        for s in active:
            credit[s] += capacity * shares[s] / total
        heap = [(-credit[s], rank[s]) for s in active]
        heapq.heapify(heap)
        room, items = capacity, []
        while heap:
            _, i = heap[0]
            s = names[i]
            size = queues[s].largest(room)
            if size < 0:
                heapq.heappop(heap)  # nothing of it fits, nor will it later in this container
                continue
            items.append(queues[s].take(size))
            room -= size
            credit[s] -= size
            heapq.heapreplace(heap, (-credit[s], i))
        out.append((room, items))
    return out


def _packer(capacity: int, round_no: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        rows = group.sort_by([("doc_id", "ascending"), ("piece_no", "ascending"), ("n_tokens", "ascending"), ("source", "ascending")]).to_pylist()
        queues: dict[str | None, Queue] = {}
        shares: dict[str | None, float] = {}
        credit: dict[str | None, float] = {}
        closed: list[list[tuple]] = []
        for r in rows:
            s = r["source"]
            shares[s] = r["share"]
            credit[s] = credit.get(s, 0.0) + (r["credit"] or 0.0)
            if r["kind"] == "credit":
                continue
            queue = queues.setdefault(s, Queue())
            size, start, piece = r["n_tokens"], r["start_token"], r["piece_no"]
            while size > capacity:  # only a text larger than a container is divided
                closed.append([(r["doc_id"], piece, start, capacity, s)])
                credit[s] -= capacity
                size, start, piece = size - capacity, start + capacity, piece + 1
            queue.add(size, (r["doc_id"], piece, start, size, s))
        for s in credit:  # the containers of divided texts credit all sources as others do
            credit[s] += shares[s] * capacity * len(closed)
        packed = fill(queues, shares, credit, capacity)
        packed.sort(key=lambda c: c[0])
        if last:
            keep = 0
        else:
            keep = min(CARRIED, sum(room > (1 - FULL) * capacity for room, _ in packed))
        closed += [items for _, items in packed[: len(packed) - keep]]
        carried = [items for _, items in packed[len(packed) - keep :]]
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}

        def emit(*values: object) -> None:
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)

        base = (round_no << 56) | (chunk << 24)
        for n, items in enumerate(closed):
            for d, piece, start, size, s in items:
                emit("placed", chunk // FAN, d, piece, start, size, s, shares[s], None, base + n)
        for items in carried:
            for d, piece, start, size, s in items:
                emit("item", chunk // FAN, d, piece, start, size, s, shares[s], None, None)
        if not last:
            for s, c in credit.items():
                emit("credit", chunk // FAN, None, None, None, None, s, shares[s], c, None)
        kinds = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64()}
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in SCHEMA.split(", ")})

    return run


def pack(items: DataFrame, capacity: int, targets: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The container of each text or piece: doc_id, piece_no, start_token, n_tokens, source, container_id.

    ``items`` has doc_id, source and n_tokens; ``targets`` (source, share) are the wanted token proportions,
    by default those of the items themselves. Every item is placed, whatever the targets: when a source
    runs out, the others take its part. Texts over ``capacity`` are divided into full containers and a rest.
    Defined cases: texts of no tokens (null, empty) are placed too and take no space; null is a source of
    its own, sources without a target have share 0; repeated doc_ids are items of their own; an empty input
    gives no rows. The result depends on the rows' order in storage only in which chunk a row falls.
    """
    sized = materialize(items.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens")), "sized")
    size = sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")).first()
    if targets is None:
        per_source = sized.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("share"))
    else:
        per_source = targets.select(F.col("source").cast("string"), F.col("share").cast("double"))
    per_source = per_source.withColumnsRenamed({"source": "_source"})
    n_chunks = max(1, math.ceil(size["rows"] / chunk_rows), math.ceil((size["tokens"] or 0) / chunk_tokens))
    chunk = F.pmod(F.xxhash64("doc_id", "source", F.monotonically_increasing_id()), F.lit(n_chunks)).cast("long")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if per_source.count() <= BROADCAST_SOURCES:
        joined = sized.withColumn("chunk", chunk).join(F.broadcast(per_source), same, "left")
    else:  # rows of a hot source are spread over the copies of its share
        copies = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(FAN)).cast("int")
        joined = sized.withColumn("chunk", chunk).withColumn("salt", salt).join(copies, same & (F.col("salt") == F.col("_salt")), "left")
    zero = F.lit(0)
    todo = joined.select(
        F.lit("item").alias("kind"), "chunk", "doc_id", zero.cast("int").alias("piece_no"), zero.cast("long").alias("start_token"),
        "n_tokens", "source", F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(None).cast("double").alias("credit"),
    )
    placed, round_no = None, 0
    while True:
        last = n_chunks == 1
        done = materialize(spread(todo, ["chunk"]).groupBy("chunk").applyInArrow(_packer(capacity, round_no, last), SCHEMA), "packed")
        part = done.where("kind = 'placed'").select("doc_id", "piece_no", "start_token", "n_tokens", "source", "container_id")
        placed = part if placed is None else placed.unionByName(part)
        if last:
            return placed
        todo = done.where("kind <> 'placed'").select(*todo.columns)
        n_chunks, round_no = math.ceil(n_chunks / FAN), round_no + 1


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and unused space, in all."""
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_items"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.sum(capacity - F.col("used")).alias("unused"), F.max("used").alias("most_used"),
    )


def mixture(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens of each source in each container that has any of it, against the source's target: container_id, source,
    n_tokens, share (of the container's tokens), target (share of all targets, 0 without one). ``targets`` as in ``pack``."""
    wanted = targets.groupBy(F.col("source").cast("string").alias("_source")).agg(F.max("share").cast("double").alias("_t"))
    every = wanted.agg(F.sum("_t")).first()[0] or 1.0
    per = placed.groupBy("container_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    used = F.sum("n_tokens").over(Window.partitionBy("container_id"))  # a row a source
    per = per.withColumn("share", F.col("n_tokens") / used).where("n_tokens > 0")
    joined = per.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("container_id", "source", "n_tokens", "share", (F.coalesce("_t", F.lit(0.0)) / every).alias("target"))


def deviation(mixed: DataFrame) -> DataFrame:
    """Per source: target, n_tokens, share of all tokens, n_containers that have it, and the mean distance of a
    container's share from the target over all containers."""
    mixed = materialize(mixed, "mixture")
    n, tokens = mixed.agg(F.count_distinct("container_id"), F.sum("n_tokens")).first()
    per = mixed.groupBy("source").agg(F.max("target").alias("target"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"), F.sum(F.abs(F.col("share") - F.col("target"))).alias("away"))
    away = (F.col("away") + (F.lit(n) - F.col("n_containers")) * F.col("target")) / F.lit(n or 1)
    return per.select("source", "target", "n_tokens", (F.col("n_tokens") / F.lit(tokens or 1)).alias("share"), "n_containers", away.alias("mean_away"))


def shortfalls(items: DataFrame, placed: DataFrame, capacity: int) -> DataFrame:
    """What is wrong with a placing, a row of (kind, n), all but ``items`` 0 if it is whole: ``missing`` items whose pieces don't
    make up their tokens in order, ``divided`` without need, containers ``over`` capacity. doc_ids must be unique."""
    own = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_token", "n_tokens"))).alias("p"))
    both = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size")).join(own, "doc_id", "full")
    end = F.aggregate("p", F.lit(0).cast("long"), lambda at, x: F.when(x["start_token"] == at, at + x["n_tokens"]).otherwise(-1))
    whole = F.coalesce(end == F.col("size"), F.lit(False))
    need = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity))
    rows = both.agg(F.count(F.lit(1)).alias("items"), F.count_if(~whole).alias("missing"), F.count_if(F.size("p") > need).alias("divided"))
    over = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("u")).agg(F.count_if(F.col("u") > capacity).alias("over"))
    return rows.unpivot([], ["items", "missing", "divided"], "kind", "n").unionByName(over.unpivot([], ["over"], "kind", "n"))
