"""Aggregates over runs, clips and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIMES = ("staging_seconds", "file_hash_seconds", "clock_read_seconds", "wall_clock_seconds")
#: Seconds a detector call takes, cost of an hour, share of frames skipped where none is known.
CALL_SECONDS, HOUR_COST, DEFAULT_FILTER = 0.0215, 0.35, 88.3


def _sum0(c: str):
    return F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(c)


def timing_totals(clips: DataFrame, run_id: str | None = None) -> DataFrame:
    """Sums of the times of a run's clips; of each run if none is named."""
    if run_id is None:
        return clips.groupBy("run_id").agg(*[_sum0(c) for c in TIMES])
    return clips.where(F.col("run_id") == run_id).agg(*[_sum0(c) for c in TIMES])


def latest_run(runs: DataFrame, completed: bool = False) -> DataFrame:
    """(run_id): the run that began last; of equal starts the greatest id."""
    rows = runs.where("status = 'COMPLETED'") if completed else runs
    return rows.agg(F.max(F.struct("started_at", "run_id")).alias("r")).select(F.col("r.run_id").alias("run_id"))


def clip_statistics(clips: DataFrame, runs: DataFrame) -> DataFrame:
    """Sums over the completed clips of the latest run, or of all runs if it has none, in one pass over the clips."""
    last = F.broadcast(latest_run(runs).withColumn("latest", F.lit(1)))
    done = clips.where("status = 'COMPLETED'").join(last, "run_id", "left")
    sums = ("duration_sec", "total_frames", "wall_clock_seconds", "decode_seconds", "vehicle_detection_seconds")
    part = lambda own: F.struct(F.count(F.when(own, 1)).alias("clips"), *[F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast("double").alias(c) for c in sums])
    both = done.agg(part(F.col("latest") == 1).alias("l"), part(F.lit(True)).alias("a"))
    return both.select(F.when(F.col("l.clips") > 0, F.col("l")).otherwise(F.col("a")).alias("s")).select("s.*")


def kpis(stats: DataFrame, hour_cost: float = HOUR_COST) -> DataFrame:
    """Ratios of one row of clip statistics; a division by nothing gives 0."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    wall, video = F.col("wall_clock_seconds"), F.col("duration_sec")
    calls = F.round(F.col("vehicle_detection_seconds") / CALL_SECONDS)
    cost = wall / 3600 * hour_cost
    return stats.select(
        "clips", (video / 60).alias("video_minutes"), (wall / 60).alias("wall_minutes"), over(video, wall).alias("speed_ratio"),
        over(F.col("total_frames"), wall).alias("fps"), cost.alias("cost"), over(cost, video / 3600).alias("cost_per_video_hour"),
        calls.cast("bigint").alias("detector_calls"),
        F.when(F.col("total_frames") > 0, (1 - calls / F.col("total_frames")) * 100).otherwise(DEFAULT_FILTER).alias("filter_ratio"),
    )


def event_counts(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events that aren't duplicates, by plate state, vehicle type and direction; zeros where there are none."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    kinds = [n(F.col("vehicle_type") == k, name) for k, name in (("car", "cars"), ("truck", "trucks"), ("motorcycle", "motorcycles"), ("bus", "buses"))]
    return events.where("duplicate_of is null").groupBy(*(by or [])).agg(
        F.count("*").alias("events"), n(F.col("plate_status") == "OK", "plates_ok"), *kinds,
        n(F.col("direction") == "ENTRADA", "entries"), n(F.col("direction") == "SALIDA", "exits"),
    )


def latency_blocks(calls: DataFrame, by: list[str], order: list[str], value: str, size: int = 200) -> DataFrame:
    """Blocks of so many consecutive calls: count, mean, least and greatest in milliseconds, and their range."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    block = calls.withColumn("block", F.floor(place / size))
    out = block.groupBy(*by, "block").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 1).alias("mean_ms"), F.round(F.min(value), 1).alias("min_ms"), F.round(F.max(value), 1).alias("max_ms")
    )
    first = F.col("block") * size
    return out.withColumn("range", F.format_string("%4d - %4d", first + 1, first + F.col("n")))


def stage_summary(stages: DataFrame, wall: DataFrame, by: str) -> DataFrame:
    """Seconds, calls and share of the wall clock of each stage."""
    sums = stages.groupBy(by, "stage").agg(F.sum("seconds").alias("s"), F.sum("calls").cast("bigint").alias("calls"))
    share = F.round(F.coalesce(F.try_divide(F.col("s"), F.col("wall")), F.lit(0.0)) * 100, 1)
    return sums.join(wall, by).select(by, "stage", F.round("s", 3).alias("seconds"), "calls", share.alias("pct"))


def clip_deltas(counters: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """What a running counter gained since the row before; the first row gained all it has."""
    w = Window.partitionBy(*by).orderBy(*order)
    return counters.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)))


def percentiles(calls: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median and 95th percentile with linear interpolation, mean, least and greatest."""
    return calls.groupBy(*by).agg(
        F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def gap_breakdown(totals: DataFrame, by: list[str]) -> DataFrame:
    """A row for each segment of a run's wall clock: seconds and percentage of the total."""
    names = {"Startup": "startup_seconds", "Staging/Copy": "staging_seconds", "File Hash": "file_hash_seconds", "OSD Clock Read": "clock_read_seconds", "Clip Processing": "wall_clock_seconds", "Excel Export": "export_seconds"}
    stack = ", ".join(f"'{k}', {v}" for k, v in names.items())
    long = totals.select(*by, "total_wall", F.expr(f"stack({len(names)}, {stack}) as (segment, seconds)"))
    wall = F.when(F.col("total_wall") > 0, F.col("total_wall")).otherwise(1.0)
    return long.select(*by, "segment", "seconds", F.round(F.col("seconds") / wall * 100, 1).alias("pct"))


def run_totals(clips: DataFrame, total_wall: str = "total_wall") -> DataFrame:
    """Sums of a run and its speed: video over processing time, over the whole wall clock if no clip was timed."""
    sums = clips.groupBy("run_id").agg(
        F.sum("processed_events").cast("bigint").alias("events"), F.sum("total_frames").cast("bigint").alias("frames"),
        F.sum("duration_sec").alias("video_s"), F.sum("wall_clock_seconds").alias("process_s"), F.max(total_wall).alias("total_wall"),
    )
    base = F.when(F.col("process_s") > 0, F.col("process_s")).otherwise(F.col("total_wall"))
    return sums.withColumn("speed_ratio", F.coalesce(F.try_divide("video_s", base), F.lit(0.0)))


def sweep(cases: DataFrame, grids: dict[str, list], measure, by: list[str]) -> DataFrame:
    """measure(rows with one column for each parameter) over every combination of a fixed grid, then grouped.

    The grid is exploded beside each case, so the cases are read once and nothing is cross-joined.
    """
    rows = cases
    for name, values in grids.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows.groupBy(*grids, *by).agg(*measure)


def hit_rate(crops: DataFrame, by: list[str]) -> DataFrame:
    """Share of crops with a detection, mean confidence of the best, mean latency."""
    return crops.groupBy(*by).agg(
        (F.avg((F.col("n_found") > 0).cast("double")) * 100).alias("hit_pct"),
        F.avg(F.when(F.col("n_found") > 0, F.col("best_conf"))).alias("mean_conf"), F.avg("ms").alias("mean_ms"),
    )
