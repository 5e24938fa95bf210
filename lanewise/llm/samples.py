"""Bounded, repeatable samples of rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def bounded(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """About `most` ids of each value of `by`, at the most 1.3 times as many but for a chance of almost nothing: those
    whose hashed doc_id is lowest, with all their rows.  Rows without a doc_id are left out.  Counting reads no text."""
    known = rows.where("doc_id is not null")
    counts = known.select("doc_id", *by).distinct().groupBy(*by).agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("n"))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    # The counts have one row for each class.
    return known.join(F.broadcast(counts.withColumn("share", share)), list(by)).where(spot < F.col("share")).drop("n", "share")


def one_text(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each value of `by`, with the least of its texts: ids that repeat don't widen a sample."""
    return rows.groupBy(*by).agg(F.min("text").alias("text"))
