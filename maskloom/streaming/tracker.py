"""Track life-cycle as a keyed stateful operator: one state per video, frames in order.

Each frame's detections are matched with the objects' last boxes. The rules are data, in ``Settings``: new
objects from unmatched strong detections, removal of objects that go unmatched or double another within
their first frames, a clamped keep-alive counter, confirmation after consecutive matches, and emission
held back so that removals and confirmations still take effect on earlier frames. ``Tracker`` is plain
Python over one video; ``track_batch`` and ``track_stream`` run it per video, with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.grouped import spread


@dataclass(frozen=True)
class Settings:
    """Fixed default values of the life-cycle."""

    hotstart_delay: int = 15
    unmatched_limit: int = 8
    duplicate_limit: int = 8
    assoc_iou: float = 0.1
    track_assoc_iou: float = 0.5
    new_score: float = 0.7
    keep_alive_start: int = 30
    keep_alive_low: int = -1
    keep_alive_high: int = 30
    suppress_only_in_hotstart: bool = True
    confirm_after: int = 1
    max_objects: int = 10_000

    def without_heuristics(self) -> Settings:
        return replace(self, hotstart_delay=0, unmatched_limit=0, duplicate_limit=0, confirm_after=1)


@dataclass
class Tracked:
    first_frame: int
    box: list[float]
    score: float
    keep_alive: int
    unmatched: int = 0
    run: int = 0
    confirmed: bool = False


@dataclass
class Tracker:
    """The state of one video; JSON in and out, so that it fits any state store."""

    settings: Settings = field(default_factory=Settings)
    next_id: int = 0
    last_frame: int = -1
    objects: dict[int, Tracked] = field(default_factory=dict)
    doubles: dict[str, int] = field(default_factory=dict)
    removed: list[int] = field(default_factory=list)
    buffer: list[dict] = field(default_factory=list)
    unconfirmed: dict[int, list[int]] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "settings"})

    @classmethod
    def load(cls, text: str, settings: Settings) -> Tracker:
        d = json.loads(text)
        objects = {int(k): Tracked(**v) for k, v in d["objects"].items()}
        return cls(settings, d["next_id"], d["last_frame"], objects, d["doubles"], d["removed"], d["buffer"], {int(k): v for k, v in d["unconfirmed"].items()})

    def step(self, frame: int, detections: list[tuple[float, list[float]]], last: bool) -> list[dict]:
        """One frame in; the frames that leave the buffer, each as rows."""
        s, ids = self.settings, sorted(self.objects)
        overlaps = _ious([b for _, b in detections], [self.objects[i].box for i in ids])
        matched: dict[int, list[int]] = {d: [ids[k] for k in np.flatnonzero(overlaps[d] >= s.assoc_iou)] for d in range(len(detections))}
        hit = {i for own in matched.values() for i in own}
        unmatched = [i for k, i in enumerate(ids) if not (len(detections) and (overlaps[:, k] >= s.track_assoc_iou).any())]
        fresh = [d for d, (score, _) in enumerate(detections) if score >= s.new_score and not matched[d]]
        room = max(0, s.max_objects - len(ids))
        fresh = sorted(sorted(fresh, key=lambda d: (-detections[d][0], d))[:room])
        for d in fresh:
            score, box = detections[d]
            self.objects[self.next_id] = Tracked(frame, box, score, s.keep_alive_start)
            hit.add(self.next_id)
            self.next_id += 1
        for d, own in matched.items():
            for i in own:
                if overlaps[d][ids.index(i)] == overlaps[:, ids.index(i)].max():
                    self.objects[i].box, self.objects[i].score = detections[d][1], detections[d][0]
        suppressed = self._hotstart(frame, matched, hit, unmatched)
        for i, o in self.objects.items():
            o.run = o.run + 1 if i in hit else 0
            o.confirmed |= o.run >= s.confirm_after
        self.unconfirmed[frame] = [i for i, o in self.objects.items() if not o.confirmed]
        rows = [{"obj_id": i, "score": o.score, "box": o.box} for i, o in sorted(self.objects.items()) if i in hit or i not in unmatched]
        self.buffer.append({"frame": frame, "rows": rows, "suppressed": suppressed})
        self.last_frame = frame
        return self._leaving(last)

    def _hotstart(self, frame: int, matched: dict[int, list[int]], hit: set[int], unmatched: list[int]) -> list[int]:
        s, gone, quiet = self.settings, [], []
        early = lambda i: self.objects[i].first_frame > frame - s.hotstart_delay
        for i in {i for own in matched.values() for i in own}:  # once a frame, however many detections match
            o = self.objects[i]
            o.keep_alive = min(s.keep_alive_high, o.keep_alive + 1)
        for i in unmatched:
            o = self.objects[i]
            o.unmatched += 1
            o.keep_alive = max(s.keep_alive_low, o.keep_alive - 1)
        for i, o in self.objects.items():
            if s.unmatched_limit and o.unmatched >= s.unmatched_limit and early(i):
                gone.append(i)
            elif o.keep_alive <= 0 and not s.suppress_only_in_hotstart:
                quiet.append(i)
        for own in matched.values():
            if len(own) > 1:
                first = min(own, key=lambda i: (self.objects[i].first_frame, i))
                for i in own:
                    if i != first:
                        self.doubles[f"{first}:{i}"] = self.doubles.get(f"{first}:{i}", 0) + 1
        for pair, n in self.doubles.items():
            i = int(pair.split(":")[1])
            if s.duplicate_limit and n >= s.duplicate_limit and i in self.objects and i not in gone and early(i):
                gone.append(i)
        for i in gone:
            del self.objects[i]
            hit.discard(i)
        self.removed += gone
        return quiet

    def _leaving(self, last: bool) -> list[dict]:
        s = self.settings
        if last or s.hotstart_delay <= 0:
            out, self.buffer = self.buffer, []
        elif len(self.buffer) >= s.hotstart_delay:
            out, self.buffer = self.buffer[:1], self.buffer[1:]
        else:
            out = []
        emitted = []
        for f in out:
            look = min(f["frame"] + s.confirm_after - 1, self.last_frame)
            hidden = {*self.removed, *f["suppressed"], *self.unconfirmed.get(look, [])}
            emitted += [{"frame_idx": f["frame"], **r} for r in f["rows"] if r["obj_id"] not in hidden]
            self.unconfirmed.pop(f["frame"] - 1, None)
        return emitted


def _ious(a: list[list[float]], b: list[list[float]]) -> np.ndarray:
    if not a or not b:
        return np.zeros((len(a), len(b)))
    p, q = np.asarray(a, float)[:, None], np.asarray(b, float)[None]
    w = np.minimum(p[..., 0] + p[..., 2], q[..., 0] + q[..., 2]) - np.maximum(p[..., 0], q[..., 0])
    h = np.minimum(p[..., 1] + p[..., 3], q[..., 1] + q[..., 3]) - np.maximum(p[..., 1], q[..., 1])
    i = np.maximum(w, 0) * np.maximum(h, 0)
    u = p[..., 2] * p[..., 3] + q[..., 2] * q[..., 3] - i
    return np.divide(i, u, out=np.zeros_like(i), where=u > 0)


OUT = "video_id BIGINT, frame_idx INT, obj_id BIGINT, score DOUBLE, box ARRAY<DOUBLE>, late BOOLEAN"
IN = "video_id BIGINT, frame_idx INT, n_frames INT, detections ARRAY<STRUCT<score: DOUBLE, box: ARRAY<DOUBLE>>>"


def frame_rows(detections: DataFrame) -> DataFrame:
    """One row a frame, in the operator's input schema, from rows video_id, frame_idx, n_frames, score, box. A
    frame has the detections of an image, a bounded number; a frame without any still needs a row."""
    d = F.when(F.col("box").isNotNull(), F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), F.transform("box", lambda v: v.cast("double")).alias("box")))
    packed = detections.groupBy("video_id", "frame_idx").agg(F.max("n_frames").alias("n_frames"), F.array_sort(F.collect_list(d)).alias("detections"))
    return packed.select(F.col("video_id").cast("long"), F.col("frame_idx").cast("int"), F.col("n_frames").cast("int"), "detections")


def _run(video: int, tracker: Tracker, frames: pd.DataFrame) -> Iterator[dict]:
    """Frames in order; one that comes after a later frame is reported as late rather than lost."""
    for f in frames.sort_values("frame_idx", kind="stable").itertuples(index=False):
        if f.frame_idx <= tracker.last_frame:
            yield {"video_id": video, "frame_idx": f.frame_idx, "obj_id": None, "score": None, "box": None, "late": True}
            continue
        detections = [(float(d["score"]), [float(v) for v in d["box"]]) for d in f.detections]
        for r in tracker.step(int(f.frame_idx), detections, f.frame_idx == f.n_frames - 1):
            yield {"video_id": video, **r, "late": False}


def _frame(rows: Iterable[dict]) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=["video_id", "frame_idx", "obj_id", "score", "box", "late"])
    return out.astype({"video_id": "Int64", "frame_idx": "Int32", "obj_id": "Int64", "score": "float64"})


def track_batch(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All frames of each video at once; rows of ``OUT``."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tracker = Tracker(settings)
        rows = list(_run(int(key[0]), tracker, group))
        rows += [{"video_id": int(key[0]), **r, "late": False} for r in tracker._leaving(True)]
        return _frame(rows)

    known = frames.where("video_id IS NOT NULL AND frame_idx IS NOT NULL")
    return spread(known, ["video_id"]).groupBy("video_id").applyInPandas(run, OUT)


def track_stream(frames: DataFrame, settings: Settings = Settings(), idle: str | None = None) -> DataFrame:
    """The same over a stream of frames. A video's buffer leaves with its last frame (``n_frames`` - 1), or
    when no frame came for ``idle`` milliseconds of processing time; then its state is dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        video = int(key[0])
        tracker = Tracker.load(state.get[0], settings) if state.exists else Tracker(settings)
        if state.hasTimedOut:
            yield _frame({"video_id": video, **r, "late": False} for r in tracker._leaving(True))
            state.remove()
            return
        group = pd.concat(list(batches))
        rows = list(_run(video, tracker, group))
        if tracker.last_frame >= int(group["n_frames"].max()) - 1:  # the video is over: only its last frame is kept, to tell late ones
            tracker.objects, tracker.doubles, tracker.removed, tracker.unconfirmed = {}, {}, [], {}
        state.update((tracker.dump(),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield _frame(rows)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return frames.where("video_id IS NOT NULL AND frame_idx IS NOT NULL").groupBy("video_id").applyInPandasWithState(run, OUT, "state STRING", "append", timeout)
