"""Sessions and action logs as tables, message logs, and plug-in points."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INSTANCE = ("add", "remove", "refine")
PROPAGATION = ("propagation_full", "propagation_partial", "propagation_fetch")


def checked(log: DataFrame) -> DataFrame:
    """The log; reading a row of an unknown type is an error."""
    known = F.col("type").isin(*INSTANCE, *PROPAGATION)
    return log.withColumn("type", F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown action type: "), F.coalesce("type", F.lit("null"))))))


def plan(log: DataFrame, n_frames: int) -> DataFrame:
    """What each session does next: session_id, propagation_type, obj_ids (null: all or none).

    After actions on objects: a partial propagation of the objects added or refined since the last propagation,
    a fetch if there are none. After a propagation: a fetch, unless it was the first of two directions
    (neither a propagation before it nor at an end of the video), which is then repeated. ``log``: session_id,
    seq (unique per session), type, frame_idx, obj_ids. A session without rows has no plan here; it is full.
    """
    by = Window.partitionBy("session_id").orderBy("seq")
    whole = Window.partitionBy("session_id")
    is_prop = F.col("type").isin(*PROPAGATION)
    marked = log.withColumns({"_last_prop": F.max(F.when(is_prop, F.col("seq"))).over(whole), "_before": F.lag("type").over(by), "_last": F.max("seq").over(whole)})
    touched = F.array_distinct(F.flatten(F.collect_list(F.when((F.col("seq") > F.coalesce("_last_prop", F.col("seq") - 1)) & F.col("type").isin("add", "refine"), F.coalesce("obj_ids", F.array().cast("array<bigint>"))))))
    end = F.max(F.when(F.col("seq") == F.col("_last"), F.struct("type", "frame_idx", "obj_ids", "_before")))
    last = marked.groupBy("session_id").agg(touched.alias("touched"), end.alias("e"))
    ran = F.col("e.type").isin("propagation_full", "propagation_partial")
    done = (F.col("e.type") == "propagation_fetch") | (ran & (F.coalesce(F.col("e._before").isin("propagation_full", "propagation_partial"), F.lit(False)) | F.coalesce(F.col("e.frame_idx").isin(0, n_frames - 1), F.lit(False))))
    kind = F.when(done, "propagation_fetch").when(ran, F.col("e.type")).when(F.size("touched") > 0, "propagation_partial").otherwise("propagation_fetch")
    ids = F.when(~done & ran, F.col("e.obj_ids")).when(~done & ~ran & (F.size("touched") > 0), F.array_sort("touched"))
    return last.select("session_id", kind.alias("propagation_type"), ids.alias("obj_ids"))


def refined(log: DataFrame) -> DataFrame:
    """Objects that were ever added or refined: session_id, obj_id."""
    return log.where(F.col("type").isin("add", "refine")).select("session_id", F.explode("obj_ids").alias("obj_id")).distinct()


def open_sessions(requests: DataFrame) -> DataFrame:
    """Sessions whose last start is after their last close: session_id, started. Closing twice is no error."""
    last = requests.groupBy("session_id").agg(F.max(F.when(F.col("type") == "start_session", F.col("seq"))).alias("started"), F.max(F.when(F.col("type") == "close_session", F.col("seq"))).alias("closed"))
    return last.where(F.col("started").isNotNull() & (F.col("closed").isNull() | (F.col("closed") < F.col("started")))).select("session_id", "started")


def pruned(messages: DataFrame, is_call: Column, keep_first: int = 2) -> DataFrame:
    """Of each conversation the first messages, and those from the last assistant call on (none, without a
    call). ``messages``: conv_id, turn, role and others."""
    w = Window.partitionBy("conv_id")
    n = F.row_number().over(w.orderBy("turn"))
    m = messages.withColumn("_n", n).withColumn("_from", F.max(F.when((F.col("role") == "assistant") & is_call & (F.col("_n") > keep_first), F.col("_n"))).over(w))
    return m.where((F.col("_n") <= keep_first) | (F.col("_n") >= F.col("_from"))).drop("_n", "_from")


def unused_prompts(prompts: DataFrame, used: DataFrame) -> DataFrame:
    """Prompts that weren't tried in their conversation before."""
    return prompts.join(used, ["conv_id", "prompt"], "left_anti")


def verdict(text: Column) -> Column:
    """What stands in <verdict>...</verdict>: Accept or Reject, else null."""
    found = F.initcap(F.trim(F.regexp_extract(text, r"(?is)<verdict>\s*(accept|reject)\s*</verdict>", 1)))
    return F.nullif(found, F.lit(""))


class SessionLog:
    """Requests as rows of an action log in a folder; sessions and plans are read from it.

    Requests are dicts with ``type`` (start_session, add_prompt, remove_object, reset_session, close_session or
    propagate) and ``session_id``. Each call appends one small file; many clients may write, as a row's ``seq`` is
    the time in nanoseconds with the client's number in the last digits.
    """

    ACTIONS = {"add_prompt": "add", "refine_prompt": "refine", "remove_object": "remove"}
    OTHERS = ("start_session", "reset_session", "close_session")
    SCHEMA = "session_id STRING, seq BIGINT, type STRING, frame_idx INT, obj_ids ARRAY<BIGINT>"

    def __init__(self, spark: SparkSession, folder: str, n_frames: int, client: int = 0):
        self.spark, self.folder, self.n_frames, self.client = spark, folder, n_frames, client

    def _append(self, session: str, kind: str, frame: int | None = None, ids: list[int] | None = None) -> None:
        row = (session, time.time_ns() // 100 * 100 + self.client, kind, frame, ids)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def is_open(self, session: str) -> bool:
        return bool(open_sessions(self.rows().where(F.col("session_id") == session)).head(1))

    def handle(self, request: dict) -> dict:
        """Log the request; ``propagate`` also answers with what is to be done and logs that."""
        kind, session = request["type"], request["session_id"]
        if kind not in self.ACTIONS and kind not in self.OTHERS and kind != "propagate":
            raise ValueError(f"unknown request type: {kind}")
        if kind not in ("start_session", "close_session") and not self.is_open(session):
            raise ValueError(f"no open session {session}; it may have expired")
        if kind != "propagate":
            self._append(session, self.ACTIONS.get(kind, kind), request.get("frame_idx"), request.get("obj_ids"))
            return {"session_id": session}
        log = self.rows().where(F.col("session_id") == session)
        since = log.where(F.col("type").isin("start_session", "reset_session")).agg(F.max("seq").alias("s")).first()["s"]
        todo = plan(log.where((F.col("seq") > since) & F.col("type").isin(*INSTANCE, *PROPAGATION)), self.n_frames).first()
        answer = {"session_id": session, "propagation_type": todo["propagation_type"] if todo else "propagation_full", "obj_ids": todo["obj_ids"] if todo else None}
        self._append(session, answer["propagation_type"], request.get("frame_idx"), answer["obj_ids"])
        return answer


class DatasetPlugin(Protocol):
    """A source of canonical frames."""

    def truth(self) -> DataFrame: ...

    def tracker(self, name: str) -> DataFrame: ...


class Metric(Protocol):
    """A user-defined metric: counters per unit, their merge, and the final ratios."""

    def per_unit(self, truth: DataFrame, tracker: DataFrame) -> DataFrame: ...

    def combine(self, units: DataFrame, by: list[str]) -> DataFrame: ...

    def finalize(self, counters: DataFrame) -> DataFrame: ...


EVALUATORS: dict[str, Callable[..., DataFrame]] = {}


def evaluator(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register an evaluator of prediction tables under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in EVALUATORS:
            raise ValueError(f"{name} is registered already")
        EVALUATORS[name] = f
        return f

    return add


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps one after the other; none: the frame itself."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
