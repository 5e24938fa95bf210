"""Adaptive sampling, suppression of overlapping boxes, and association of boxes to tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.boxes import iou


def _schema(rows: DataFrame, more: str) -> str:
    return f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, {more}"


def adaptive_sampling(frames: DataFrame, clip: str = "clip_id", s: Settings = DEFAULT) -> DataFrame:
    """frames(clip, frame_idx, t_s, motion, vehicle) with state and run: whether the detector looks at the frame.

    vehicle tells what the detector would find there; it counts only where the detector runs, so the fold feeds on its
    own results and is sequential within a clip.
    """
    rate = {"ACTIVE": s.active_fps, "PRE-ACTIVE": s.preactive_fps, "SLEEP": s.sleep_fps}
    pause = {k: 1.0 / max(0.1, v) for k, v in rate.items()}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_s", "frame_idx"], kind="stable")
        vehicle_at = motion_at = run_at = -1e9
        states, runs = [], []
        for t, motion, vehicle in zip(pdf.t_s, pdf.motion, pdf.vehicle, strict=True):
            if motion:
                motion_at = t
            state = "ACTIVE" if t - vehicle_at <= s.active_hold else "PRE-ACTIVE" if t - motion_at <= s.preactive_hold else "SLEEP"
            run = t - run_at >= pause[state]
            if run:
                run_at = t
                vehicle_at = t if vehicle else vehicle_at
            states.append(state)
            runs.append(run)
        return pdf.assign(state=states, run=runs)

    return frames.groupBy(clip).applyInPandas(fold, _schema(frames, "state string, run boolean"))


def _overlaps(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(box[..., 2], boxes[..., 2]) - np.maximum(box[..., 0], boxes[..., 0]), 0, None)
    h = np.clip(np.minimum(box[..., 3], boxes[..., 3]) - np.maximum(box[..., 1], boxes[..., 1]), 0, None)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    union = area(box) + area(boxes) - w * h
    return np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)


def suppressed(boxes: DataFrame, frame: str = "frame_id", limit: float = 0.45) -> DataFrame:
    """The boxes(frame, det_idx, x1, y1, x2, y2, conf) that greedy suppression leaves in each frame.

    The best box stays and takes out those that overlap it by more than the limit, whatever their class; of equal scores
    the later box goes first.  A frame's boxes are few, so a fold over its sorted array does it, inside the JVM.
    """
    corners = lambda v: [v[c] for c in ("x1", "y1", "x2", "y2")]
    rest = [c for c in boxes.columns if c not in (frame, "conf", "det_idx")]
    entry = F.struct((-F.col("conf")).alias("_a"), (-F.col("det_idx")).alias("_b"), "conf", "det_idx", *rest)
    kind = f"array<struct<_a:double,_b:int,{','.join(f'`{c}`:{boxes.schema[c].dataType.simpleString()}' for c in ('conf', 'det_idx', *rest))}>>"
    grouped = boxes.withColumns({"conf": F.col("conf").cast("double"), "det_idx": F.col("det_idx").cast("int")}).groupBy(frame)
    kept = F.aggregate(
        F.sort_array(F.collect_list(entry)).cast(kind),
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda k: iou(corners(k), corners(x)) > limit), acc).otherwise(F.array_append(acc, x)),
    )
    out = grouped.agg(kept.alias("_kept")).select(frame, F.explode("_kept").alias("_k"))
    return out.select(*[F.col(c) if c == frame else F.col(f"_k.{c}").alias(c) for c in boxes.columns])


def associated(
    boxes: DataFrame, clip: str = "clip_id", high: float = 0.20, low: float = 0.1, match: float = 0.35, lost: int = 60,
    fps: float = DEFAULT.active_fps,
) -> DataFrame:
    """boxes(clip, frame_idx, det_idx, x1, y1, x2, y2, conf) with track_id, null for boxes of no track.

    Two-round association in the manner of ByteTrack (arXiv 2110.06864): confident boxes meet tracks first, where overlap
    times confidence is 1 - match or more; weak boxes those that are left, where the overlap is a half or more; each round
    by the greatest value first.  Unmatched boxes that are 0.1 more confident than `high` begin tracks.  A track ends when
    it is lost for more frames than `lost`, which counts at 30 frames a second.  Positions move on at constant speed.
    Sequential within a clip.
    """
    longest = int(fps / 30.0 * lost)

    def pairs(tracks: list, found: np.ndarray, least: float, trust: np.ndarray) -> list[tuple[int, int]]:
        if not len(tracks) or not len(found):
            return []
        ahead = np.stack([t["box"] + t["speed"] for t in tracks])
        scores = _overlaps(ahead[:, None, :], found[None, :, :]) * trust
        near = np.argwhere(scores >= least)
        out, rows, cols = [], set(), set()
        for r, c in near[np.argsort(-scores[near[:, 0], near[:, 1]], kind="stable")].tolist():
            if r not in rows and c not in cols:
                out.append((r, c))
                rows.add(r)
                cols.add(c)
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_idx", "det_idx"], kind="stable").reset_index(drop=True)
        corners, conf = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf.conf.to_numpy(float)
        ids, tracks, made = np.zeros(len(pdf), np.int64), [], 0
        for frame, rows in pdf.groupby("frame_idx", sort=True).indices.items():
            tracks = [t for t in tracks if frame - t["seen"] <= longest]
            free = list(tracks)
            for strong in (True, False):
                own = rows[conf[rows] >= high] if strong else rows[(conf[rows] < high) & (conf[rows] >= low)]
                met = pairs(free, corners[own], 1 - match if strong else 0.5, conf[own] if strong else np.ones(len(own)))
                for r, c in met:
                    t, k = free[r], own[c]
                    step = max(1, frame - t["seen"])
                    t["speed"] = (corners[k] - t["box"]) / step
                    t["box"], t["seen"], ids[k] = corners[k], frame, t["id"]
                taken = {r for r, _ in met}
                free = [t for r, t in enumerate(free) if r not in taken]
                if strong:
                    for k in own:
                        if not ids[k] and conf[k] >= high + 0.1:
                            made += 1
                            ids[k] = made
                            tracks.append({"id": made, "box": corners[k], "speed": np.zeros(4), "seen": frame})
        return pdf.assign(track_id=pd.array([i or None for i in ids.tolist()], "Int64"))

    return boxes.groupBy(clip).applyInPandas(fold, _schema(boxes, "track_id bigint"))
