"""Crossings, sampling rates and duplicates over streams.

A stream of points is keyed by clip and track.  State is a few numbers for each open track, with an event-time timer
that ends an idle one; state never holds a trajectory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Settings

POINT = "clip_id int, track_id bigint, at timestamp, t_s double, x double, y double"
OUT = "clip_id int, track_id bigint, state string, direction string, crossing_s double, n_points bigint"
_STATE = "n bigint, x double, y double, y0 double, side boolean, stage string, direction string, crossing_s double, committed boolean"


class Crossings(StatefulProcessor):
    """Emits a track once: when it is committed, or at the end of its pause if it had crossed."""

    def __init__(self, settings: Settings = DEFAULT, idle_ms: int | None = None):
        self.s = settings
        self.idle_ms = int(settings.idle_seconds * 1000) if idle_ms is None else idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", _STATE)

    def _line(self, x: float, y: float) -> tuple[bool, float]:
        (x1, y1), (x2, y2) = self.s.line
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        return cross >= 0, abs(cross) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5

    def _meets(self, ax: float, ay: float, bx: float, by: float) -> bool:
        (cx, cy), (dx, dy) = self.s.line
        left = lambda px, py, qx, qy, rx, ry: (ry - py) * (qx - px) > (qy - py) * (rx - px)
        return left(ax, ay, cx, cy, dx, dy) != left(bx, by, cx, cy, dx, dy) and left(ax, ay, bx, by, cx, cy) != left(ax, ay, bx, by, dx, dy)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        s, out = self.s, []
        got = self.track.get() if self.track.exists() else None
        n, px, py, y0, was, stage, way, at, done = got if got is not None else (0, None, None, None, None, "OUTSIDE", None, None, False)
        frame = pd.concat(list(rows)).sort_values("t_s", kind="stable")
        latest = None
        for t, x, y, when in zip(frame.t_s, frame.x, frame.y, frame["at"], strict=True):
            side, dist = self._line(x, y)
            y0 = y if n == 0 else y0
            if stage in ("OUTSIDE", "APPROACHING"):
                stage = "APPROACHING" if dist < s.approach_distance else stage
                if n and (side != was or self._meets(px, py, x, y)):
                    stage, at = "CROSSED", t
                    way = s.increasing if side or y > py else s.decreasing
            elif stage == "CROSSED" and (dist > s.commit_distance or n >= s.commit_points - 1):
                net = y - y0
                if abs(net) > s.net_travel:
                    way = s.increasing if net > 0 else s.decreasing
                stage = "COMMITTED"
            n, px, py, was, latest = n + 1, x, y, side, when
            if stage == "COMMITTED" and not done:
                done = True
                out.append((*key, stage, way, at, n))
        self.track.update((int(n), px, py, y0, bool(was), stage, way, at, bool(done)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        out = []
        if self.track.exists():
            n, *_, stage, way, at, done = self.track.get()
            if stage == "CROSSED" and n >= 2 and not done:
                out.append((*key, stage, way, at, n))
            self.track.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def crossings(points: DataFrame, delay: str = "10 seconds", settings: Settings = DEFAULT) -> DataFrame:
    """Crossing events of a stream of points(POINT) as they are committed; needs the RocksDB state store."""
    return (
        points.withWatermark("at", delay)
        .groupBy("clip_id", "track_id")
        .transformWithStateInPandas(Crossings(settings), OUT, "Append", "EventTime")
    )


def counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events of each type in tumbling or sliding windows of event time; late ones within the delay still count."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return events.withWatermark("at", delay).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def first_plates(events: DataFrame, cooldown: str = "60 seconds") -> DataFrame:
    """The first event of each plate and direction within the cooldown: the streaming form of exact duplicates."""
    return events.withWatermark("at", cooldown).dropDuplicatesWithinWatermark(["plate", "direction"])


def visits(points: DataFrame, delay: str = "10 seconds", gap: str = "3 seconds") -> DataFrame:
    """Session windows of each track: a pause longer than the gap begins a new visit."""
    w = F.session_window("at", gap)
    return points.withWatermark("at", delay).groupBy("clip_id", "track_id", w).agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))


def latest_upsert(path: str, key: list[str]):
    """A foreachBatch function that appends each batch under its number, so a repeated batch changes nothing."""
    from ..sources import store

    def write(rows: DataFrame, batch: int) -> None:
        store.upsert(rows.sparkSession, path, rows, key, batch)

    return write


FRAME = "clip_id int, frame_idx bigint, t_s double, motion boolean, vehicle boolean"
_GATE = "clip_id int, frame_idx bigint, t_s double, state string, run boolean"


class Sampling(StatefulProcessor):
    """The sampling gate of each clip: three times are all its state.  Frames of a clip must come in order."""

    def __init__(self, settings: Settings = DEFAULT):
        self.s = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "vehicle double, motion double, run double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        s, out = self.s, []
        vehicle_at, motion_at, run_at = self.times.get() if self.times.exists() else (-1e9, -1e9, -1e9)
        pause = {k: 1.0 / max(0.1, v) for k, v in (("ACTIVE", s.active_fps), ("PRE-ACTIVE", s.preactive_fps), ("SLEEP", s.sleep_fps))}
        frame = pd.concat(list(rows)).sort_values(["t_s", "frame_idx"], kind="stable")
        for i, t, motion, vehicle in zip(frame.frame_idx, frame.t_s, frame.motion, frame.vehicle, strict=True):
            motion_at = t if motion else motion_at
            state = "ACTIVE" if t - vehicle_at <= s.active_hold else "PRE-ACTIVE" if t - motion_at <= s.preactive_hold else "SLEEP"
            run = t - run_at >= pause[state]
            run_at = t if run else run_at
            vehicle_at = t if run and vehicle else vehicle_at
            out.append((*key, i, t, state, bool(run)))
        self.times.update((float(vehicle_at), float(motion_at), float(run_at)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _GATE.split(", ")])

    def close(self) -> None:
        pass


def sampled(frames: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """frames(FRAME) with state and run, as they arrive; needs the RocksDB state store."""
    return frames.groupBy("clip_id").transformWithStateInPandas(Sampling(settings), _GATE, "Append", "None")
