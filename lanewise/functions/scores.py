"""Quality scores of vehicle frames and plate crops as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights and scales of both scores.
VEHICLE = {"sharpness": 0.35, "area": 0.35, "confidence": 0.20, "border": 0.10, "full_sharpness": 400.0, "full_area": 160000.0, "margin": 30.0}
PLATE = {"confidence": 0.10, "area": 0.40, "sharpness": 0.35, "aspect": 0.10, "overexposure": 0.05, "full_sharpness": 6500.0, "full_area": 6050.0}


def vehicle_score(sharpness: Column, area: Column, confidence: Column, edge: Column) -> Column:
    """edge: the least distance of the box to the image's border; closer than 30 pixels costs, outside more."""
    w = VEHICLE
    border = F.when(edge > w["margin"], 0.0).otherwise(1 - edge / w["margin"])
    score = (
        w["sharpness"] * F.least(F.lit(1.0), sharpness / w["full_sharpness"])
        + w["area"] * F.least(F.lit(1.0), area / w["full_area"])
        + w["confidence"] * confidence
        - w["border"] * border
    )
    return F.when(area > 0, F.greatest(F.lit(0.0), score)).otherwise(0.0)


def aspect_score(ratio: Column) -> Column:
    """Long plates and square ones fit best, what is a little off less."""
    return (
        F.when(ratio.between(1.4, 2.8) | ratio.between(0.85, 1.35), 1.0)
        .when(((ratio >= 1.2) & (ratio < 1.4)) | ((ratio > 2.8) & (ratio <= 3.4)), 0.7)
        .otherwise(0.3)
    )


def plate_score(confidence: Column, w: Column, h: Column, sharpness: Column, overexposure: Column) -> Column:
    p = PLATE
    score = (
        p["confidence"] * confidence
        + p["area"] * F.least(F.lit(1.0), w * h / p["full_area"])
        + p["sharpness"] * F.least(F.lit(1.0), sharpness / p["full_sharpness"])
        + p["aspect"] * aspect_score(w / h)
        - p["overexposure"] * overexposure
    )
    return F.when((w > 0) & (h > 0), F.greatest(F.lit(0.0), score)).otherwise(0.0)
