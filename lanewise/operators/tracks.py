"""Crossings, late emission and stitching of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions import geometry as geo
from .ordering import next_at_or_after


def crossings(points: DataFrame, by: list[str], order: list[str], s: Settings = DEFAULT) -> DataFrame:
    """One row for each track of points(*by, t_s, x, y): state, direction, and the time and place of its crossing.

    A track crosses at its first point on another side than the one before it, or whose step meets the line.  It is
    committed at the first later point that is far enough from the line or the fourth of the track; then the net travel
    decides the direction if it is long enough, else the crossing step does.  Two windows and one aggregate share one
    partitioning and one sort.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    x, y, px, py = (F.col(c) for c in ("x", "y", "_px", "_py"))
    stepped = points.withColumns(
        {"_i": F.row_number().over(w) - 1, "_side": geo.side(x, y, s.line), "_dist": geo.distance(x, y, s.line)}
    )
    stepped = stepped.withColumns({"_px": F.lag("x").over(w), "_py": F.lag("y").over(w), "_before": F.lag("_side").over(w)})
    hit = (F.col("_i") >= 1) & ((F.col("_side") != F.col("_before")) | geo.intersects(px, py, x, y, s.line))
    marked = stepped.withColumn("_c", F.min(F.when(hit, F.col("_i"))).over(Window.partitionBy(*by)))
    at_crossing = F.col("_i") == F.col("_c")
    settled = (F.col("_i") > F.col("_c")) & ((F.col("_dist") > s.commit_distance) | (F.col("_i") >= s.commit_points - 1))
    upward = (F.col("_side") == F.lit(geo.below(s.line))) | (y > py)
    tracks = marked.groupBy(*by).agg(
        F.count("*").alias("n_points"),
        F.min(F.struct("_i", "y")).alias("_first"),
        F.max(F.when(at_crossing, F.struct("t_s", "x", "y", upward.alias("up")))).alias("_cross"),
        F.min(F.when(settled, F.struct("_i", "t_s", "y"))).alias("_settled"),
        F.max((F.col("_dist") < s.approach_distance).cast("int")).alias("_near"),
    )
    travel = F.col("_settled.y") - F.col("_first.y")
    way = lambda up: F.when(up, s.increasing).otherwise(s.decreasing)
    return tracks.select(
        *by,
        "n_points",
        F.when(F.col("_settled").isNotNull(), "COMMITTED")
        .when(F.col("_cross").isNotNull(), "CROSSED")
        .when(F.col("_near") == 1, "APPROACHING")
        .otherwise("OUTSIDE")
        .alias("state"),
        F.when(F.col("_settled").isNotNull() & (F.abs(travel) > s.net_travel), way(travel > 0))
        .when(F.col("_cross").isNotNull(), way(F.col("_cross.up")))
        .alias("direction"),
        F.col("_cross.t_s").alias("crossing_s"),
        F.col("_cross.x").alias("crossing_x"),
        F.col("_cross.y").alias("crossing_y"),
        F.col("_settled.t_s").alias("committed_s"),
    )


def emitted(tracks: DataFrame, frames: DataFrame, clip: str = "clip_id", s: Settings = DEFAULT) -> DataFrame:
    """Committed tracks with emit_s: the first analysed frame of the clip at which the track is committed and the window
    after its crossing is over."""
    ready = tracks.where("state = 'COMMITTED'").withColumn(
        "ready_s", F.greatest("committed_s", F.col("crossing_s") + F.lit(s.post_window_seconds))
    )
    return next_at_or_after(ready, frames, clip, "ready_s", "t_s", "emit_s").drop("ready_s")


def segments(points: DataFrame, track: str, clip: str = "clip_id", s: Settings = DEFAULT, order: tuple = ("t_s",)) -> DataFrame:
    """points with `segment`: a track that stays unseen past the idle limit, with an analysed frame in between, begins a
    new segment."""
    w = Window.partitionBy(clip, track).orderBy(*order)
    gaps = points.withColumn("_last", F.lag("t_s").over(w)).withColumn("_due", F.col("_last") + F.lit(s.idle_seconds))
    seen = next_at_or_after(gaps, points.select(clip, "t_s"), clip, "_due", "t_s", "_frame", strict=True)
    cut = F.col("_frame").isNotNull() & (F.col("_frame") < F.col("t_s"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return seen.withColumn("segment", F.sum(cut.cast("int")).over(running).cast("int")).drop("_last", "_due", "_frame")


def late_emission(segmented: DataFrame, by: list[str], order: list[str], s: Settings = DEFAULT) -> DataFrame:
    """What pruning finds for each segment: emitted, if it has two points or more and has been on both sides of the
    line's height, or had crossed; with the direction of its net travel where the crossing gave none."""
    line_y = (s.line[0][1] + s.line[1][1]) / 2
    crossed = crossings(segmented, by, order, s)
    span = segmented.groupBy(*by).agg(
        F.min("y").alias("_low"), F.max("y").alias("_high"), F.min(F.struct(*order, "y")).alias("_a"), F.max(F.struct(*order, "y")).alias("_b"),
        F.max("t_s").alias("last_s"),
    )
    both = crossed.join(span, by)
    late = (F.col("n_points") >= 2) & (
        ((F.col("_low") < line_y) & (F.col("_high") > line_y)) | F.col("state").isin("CROSSED", "COMMITTED")
    )
    net = F.when(F.col("_b.y") > F.col("_a.y"), s.increasing).otherwise(s.decreasing)
    return both.select(
        *by,
        "n_points",
        "state",
        late.alias("emitted"),
        F.when(late, F.coalesce("direction", net)).alias("direction"),
        "crossing_s",
        "last_s",
        F.when(~late, "track_never_crossed").alias("reason"),
    )


_LARGE, _SMALL = {"truck", "bus", "car"}, {"motorcycle", "person"}


class _Live:
    """A living track of the fold: where it was last, and its crossing as crossings() defines it."""

    __slots__ = ("x", "y", "t", "kind", "root", "began", "n", "side", "crossed", "crossed_at", "settled", "emitted")

    def __init__(self, t: float, kind: str, root: int):
        self.t, self.kind, self.root, self.began = t, kind, root, t
        self.x = self.y = self.side = self.crossed = self.crossed_at = None
        self.n, self.settled, self.emitted = 0, False, False

    def move(self, t: float, x: float, y: float, s: Settings) -> None:
        (x1, y1), (x2, y2) = s.line
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        side, far = cross >= 0, abs(cross) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 > s.commit_distance
        if self.crossed is None:
            if self.n and (side != self.side or geo.segments_meet((self.x, self.y), (x, y), *s.line)):
                self.crossed, self.crossed_at = self.n, t
        elif far or self.n >= s.commit_points - 1:
            self.settled = True
        self.x, self.y, self.t, self.side, self.n = x, y, t, side, self.n + 1


def stitched(points: DataFrame, clip: str = "clip_id", s: Settings = DEFAULT, frames: DataFrame | None = None) -> DataFrame:
    """points(clip, track_id, t_s, x, y, vehicle_class) with root_id and root_s: the first id of the chain that a track
    continues and the time at which the chain began, which together name it.

    A new id continues the nearest track that was last seen 0.05 to 3 s ago, of a class that fits, within 450 pixels, and
    that hasn't been emitted; of equally near ones the one that has waited longest in the order of creation.  After each
    frame tracks whose crossing is settled and whose window after it is over count as emitted, and tracks that have been
    unseen for more than the idle limit end; an id that comes back later begins a chain of its own.  frames(clip, t_s)
    are the analysed frames; without them those with points count.  The order of frames matters, so a clip is folded in
    one task; clips are independent, and what is searched are the living tracks.
    """
    gap_low, gap_high = s.stitch_gap
    names = points.columns
    if frames is not None:
        points = points.unionByName(frames.select(clip, F.col("t_s").cast(points.schema["t_s"].dataType)), allowMissingColumns=True)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_s", "track_id", "x", "y"], kind="stable", na_position="first")
        live: dict[int, _Live] = {}
        roots, began = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
        times = pdf.t_s.to_numpy(float)
        for k, (i, t, x, y, kind) in enumerate(zip(pdf.track_id, times, pdf.x, pdf.y, pdf.vehicle_class, strict=True)):
            if not pd.isna(i):
                i = int(i)
                if i not in live:
                    best, near = None, s.stitch_distance
                    for j, old in live.items():
                        fits = old.kind == kind or {old.kind, kind} <= _LARGE or {old.kind, kind} <= _SMALL
                        if not old.emitted and fits and gap_low <= t - old.t <= gap_high and (d := float(np.hypot(x - old.x, y - old.y))) < near:
                            best, near = j, d
                    if best is None:
                        live[i] = _Live(t, kind, i)
                    else:
                        live[i] = live.pop(best)
                        live[i].kind = kind if kind != "vehicle" else live[i].kind
                live[i].move(t, x, y, s)
                roots[k], began[k] = live[i].root, live[i].began
            if k + 1 == len(times) or times[k + 1] != t:  # the frame is over
                for track in live.values():
                    track.emitted |= track.settled and t >= track.crossed_at + s.post_window_seconds
                live = {j: v for j, v in live.items() if t - v.t <= s.idle_seconds}
        return pdf.assign(root_id=roots, root_s=began)[pdf.track_id.notna()][[*names, "root_id", "root_s"]]

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in points.select(names).schema.fields)}, root_id bigint, root_s double"
    return points.groupBy(clip).applyInPandas(fold, schema)
