"""Duplicates within a clip and across clips; duplicates are marked, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings


def within_clip(emissions: DataFrame, order: list[str]) -> DataFrame:
    """emissions(clip_id, track_id, line_id) with `first`: only the first of each track and line in a clip counts.
    An emission without a frame neither counts nor uses up the key: leave those out before."""
    w = Window.partitionBy("clip_id", "track_id", "line_id").orderBy(*order)
    return emissions.withColumn("first", F.row_number().over(w) == 1)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 0 if either is missing or flat."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    dot = lambda u, v: total(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")))
    cov = dot(a, b) - total(a) * total(b) / n
    va, vb = dot(a, a) - total(a) * total(a) / n, dot(b, b) - total(b) * total(b) / n
    return F.coalesce(F.when((va > 0) & (vb > 0) & (F.size(b) == n), cov / F.sqrt(va * vb)), F.lit(0.0))


def across_clips(events: DataFrame, s: Settings = DEFAULT, histogram: str | None = None) -> DataFrame:
    """events(event_id, rn, t_s, direction, plate, ocr_conf) with duplicate_of: the latest of the last 50 events before
    it, in the same direction and within the cooldown, whose plate or looks match; else null.

    rn is the order of emission.  History holds duplicates too, so the search isn't recursive: a join on direction and
    a block of 50 numbers, with the next block, then the pair's own predicate.  Each event meets at the most 50 others.
    """
    n = s.history
    extra = [F.col(histogram)] if histogram else []
    later = events.withColumn("_block", F.floor(F.col("rn") / n))
    names = ("event_id", "rn", "t_s", "direction", "plate", "ocr_conf")
    earlier = events.select(
        *[F.col(c).alias(f"p_{c}") for c in names], *[c.alias("p_hist") for c in extra],
        F.explode(F.array(F.floor(F.col("rn") / n), F.floor(F.col("rn") / n) + 1)).alias("_block"),
    )
    near = later.join(earlier, (later["_block"] == earlier["_block"]) & (F.col("direction") == F.col("p_direction")))
    like = correlation(F.col(histogram), F.col("p_hist")) if histogram else F.lit(0.0)
    gap = F.abs(F.col("t_s") - F.col("p_t_s"))
    a, b = F.col("plate"), F.col("p_plate")
    unsure = (F.coalesce("ocr_conf", F.lit(1.0)) < 0.75) | (F.coalesce("p_ocr_conf", F.lit(1.0)) < 0.75)
    match = (
        (a.isNotNull() & b.isNotNull() & ((a == b) | ((F.levenshtein(a, b, 1) >= 0) & (unsure | (like > 0.65)))))
        | (a.isNull() & b.isNull() & (gap < 6) & (like > 0.75))
        | ((a.isNull() != b.isNull()) & (gap < 6) & (like > 0.70))
    )
    inside = (F.col("p_rn") < F.col("rn")) & (F.col("p_rn") >= F.col("rn") - n) & (gap <= s.cooldown_seconds)
    best = near.where(inside & match).groupBy(F.col("event_id")).agg(F.max(F.struct("p_rn", "p_event_id")).alias("p"))
    return events.join(best.select("event_id", F.col("p.p_event_id").alias("duplicate_of")), "event_id", "left")
