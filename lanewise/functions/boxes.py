"""Boxes, detections and letterboxes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

#: Class names of the detector.
CLASS_NAMES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}


def to_frame(v: Column, offset: int) -> Column:
    """A crop coordinate in the full frame, cut towards zero."""
    return (v + F.lit(float(offset))).cast("int")


def parked(x2: Column, y2: Column, s: Settings = DEFAULT) -> Column:
    """Boxes at the curb, which are dropped before the polygon is looked at."""
    return (x2 <= s.curb_x) & (y2 > s.curb_y)


def vehicle_class(class_id: Column) -> Column:
    """People and bicycles count as motorcycles; unknown classes are plain vehicles."""
    rider = F.when(class_id.isin(0, 1), 3).otherwise(class_id)
    name = F.lit("vehicle")
    for k, v in CLASS_NAMES.items():
        if k not in (0, 1):
            name = F.when(rider == k, v).otherwise(name)
    return name


def contact_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2 - F.lit(15.0)


def detector_box(cx: Column, cy: Column, w: Column, h: Column, scale: Column, width: int, height: int) -> list[Column]:
    """Corners of a centred box, with the letterbox's scale undone, inside the image."""
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v / scale, F.lit(float(top))))
    return [inside(cx - w / 2, width), inside(cy - h / 2, height), inside(cx + w / 2, width), inside(cy + h / 2, height)]


def plate_box_ok(w: Column, h: Column) -> Column:
    """Boxes that may hold a plate: 20 by 10 pixels or more, and not too upright."""
    return ~((w < 20) | (h < 10) | (w.cast("double") / h.cast("double") < 0.75))


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 0.15) -> list[Column]:
    """A box with a margin on each side, inside its crop."""
    dx, dy = ((b - a).cast("double") * F.lit(margin) for a, b in ((x1, x2), (y1, y2)))
    dx, dy = dx.cast("int"), dy.cast("int")
    return [
        F.greatest(F.lit(0), x1 - dx), F.greatest(F.lit(0), y1 - dy), F.least(width, x2 + dx), F.least(height, y2 + dy)
    ]


def letterbox(w: Column, h: Column, size: int) -> tuple[Column, Column, Column]:
    """(scale, width, height) of an image fitted into a square; sides are even, at least 2, halves rounded to even."""
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    even = lambda v: F.greatest(F.lit(2), (F.bround(v * scale / 2) * 2).cast("int"))
    return scale, even(w), even(h)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes over their union; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
