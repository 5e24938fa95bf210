"""Total orders over large tables without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, key: str, *ties: Column, name: str = "rn", parts: int | None = None) -> DataFrame:
    """rows with a number from 1 in the order of a numeric key, then of ties.

    Quantiles cut the key into ranges (that many numbers reach the driver); rows are numbered within their range and
    moved up by what lies in lower ranges.  Null keys come first.
    """
    spark = rows.sparkSession
    parts = parts or max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("c")).first().c or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    value = F.col(key).cast("double")
    ranged = rows.withColumn("_edges", edges).withColumn(
        "_range", F.when(value.isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e <= value)))
    ).drop("_edges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range.
    start = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key), *ties))
    found = ranged.withColumn("_local", local).join(F.broadcast(start.select("_range", "_before")), "_range")
    return found.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_range", "_before", "_local")


def next_at_or_after(probes: DataFrame, marks: DataFrame, by: str, at: str, mark: str, name: str, strict: bool = False) -> DataFrame:
    """probes with the least mark of the same `by` at or after (strict: after) the probe's time; null if there is none
    or the probe has no time.

    Both sides meet in one shuffle and one sort; nothing is paired.
    """
    left = probes.withColumns({"_t": F.col(at).cast("double"), "_mark": F.lit(None).cast("double")})
    right = marks.select(F.col(by), F.col(mark).cast("double").alias("_t")).distinct().withColumn("_mark", F.col("_t"))
    rank = F.when(F.col("_mark").isNull(), 0 if not strict else 1).otherwise(1 if not strict else 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumns({"_rank": rank, "_probe": F.col("_mark").isNull()})
    order = Window.partitionBy(by).orderBy(F.col("_t").desc(), F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(name, F.when(F.col("_t").isNotNull(), F.last("_mark", ignorenulls=True).over(order)))
    return found.where("_probe").drop("_t", "_mark", "_rank", "_probe")
