"""A stream of rows against the known windows of clips, and files as a stream taken in bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_windows(rows: DataFrame, windows: DataFrame, at: str, tolerance: float, longest: float) -> DataFrame:
    """The streaming form of matching.in_windows(): rows with the first window that holds them, null without one.

    Windows are gathered by time bucket on the static side, so each row meets one list and no state is kept; a list is as
    long as windows overlap within a bucket, whose width is the longest window.
    """
    size = longest + 2 * tolerance
    low, high = F.col("win_start") - tolerance, F.col("win_end") + tolerance
    placed = windows.select("win_idx", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias("_k"))
    lists = placed.groupBy("_k").agg(F.collect_list(F.struct("win_idx", "low", "high")).alias("_w"))
    t = F.col(at)
    hit = F.filter("_w", lambda w: (w["low"] <= t) & (t <= w["high"]))
    keyed = rows.withColumn("_k", F.floor(t / size)).join(lists, "_k", "left")
    return keyed.withColumn("win_idx", F.array_min(F.transform(hit, lambda w: w["win_idx"]))).drop("_k", "_w")


def files(spark: SparkSession, path: str, schema: T.StructType | str, most: int = 64) -> DataFrame:
    """Parquet files below a folder as a stream; a batch takes at most so many, however many wait."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)
