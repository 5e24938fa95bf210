"""Comparing ways to fuse the readings of a plate."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import plates
from . import grid

#: Numbers of readings, ways to fuse them, and priors that are compared.
TOP_K, FUSIONS, BETAS = (3, 5, 7), ("char_voting", "logprob_sum"), (0.0, 0.05, 0.10, 0.20)


def matrix(reads: DataFrame, truth: DataFrame, key: str, order: str, models: Column | None = None) -> DataFrame:
    """A row for each model, number of readings, fusion and prior: shares of exact plates, right characters and right
    first letters, first letters wrongly read as P, and events compared.

    reads(model, key, order, text, ocr_conf, plate_score) are every model's readings, truth(key, plate, legible) the
    plates; readings of one place in the order count by text and figures.  `models` makes an array of (model, text,
    ocr_conf) of a reading, if reads has no model.  Readings and plates meet in one shuffle, sorted by their key alone, and
    only then become each model's; each event's readings are judged in all cells at once, and each text that wins cells
    is compared with the plate once.
    """
    strip = lambda c: F.upper(F.replace(c, F.lit("-"), F.lit("")))
    own = F.array(F.struct("model", "text", "ocr_conf")) if models is None else models
    kind = reads.select(F.inline(own).alias("model", "text", "ocr_conf")).schema
    known = truth.where(F.coalesce(F.col("legible"), F.lit(True))).select(key, strip(F.col("plate")).alias("_plate")).where("_plate != ''")
    both = reads.unionByName(known, allowMissingColumns=True).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    plate = F.array(F.struct(*[(F.col("_plate") if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind]))
    each = both.select(
        F.col(key).alias("k"), F.col("_plate").isNull().alias("read"), F.col(order).alias("at"), F.col("plate_score").cast("double").alias("score"),
        F.inline(F.when(F.col("_plate").isNull(), own).otherwise(plate)).alias("model", "text", "conf"),
    )
    # Most texts are clean, and seeing that costs less than cleaning.
    clean = F.when(~F.col("read") | F.col("text").rlike(r"\A[A-Z0-9]+\z"), F.col("text")).otherwise(plates.clean(F.col("text")))
    rows = each.withColumn("clean", clean).where("clean is not null").select(
        "k", "read", "model", "at", F.col("clean").alias("text"), F.expr("nullif(text, clean)").alias("raw"), F.col("conf").cast("double").alias("conf"), "score"
    )
    schema = T.StructType([kind["model"], T.StructField("cells", T.LongType()), T.StructField("gt", T.StringType()), T.StructField("text", T.StringType())])
    found = rows.mapInArrow(grid.winners(TOP_K, BETAS), schema).withColumn("text", strip(F.col("text")))
    text, gt = F.col("text"), F.col("gt")
    distance, first = F.levenshtein(gt, text), F.substring(text, 1, 1)
    # Few sets of cells win together.
    sums = found.groupBy("model", "cells").agg(
        F.sum((distance == 0).cast("int")).alias("exact"), F.sum(F.greatest(F.lit(0), F.length(gt) - distance)).alias("right"), F.sum(F.length(gt)).alias("chars"),
        F.sum(((text != "") & (first == F.substring(gt, 1, 1))).cast("int")).alias("firsts"), F.count(F.when((first == "P") & ~gt.startswith("P"), 1)).alias("wrong_p"), F.count("*").alias("n"),
    )
    cell = [F.struct(F.lit(k).alias("top_k"), F.lit(f).alias("fusion"), F.lit(b).alias("beta_p")) for k, b, f in product(TOP_K, BETAS, FUSIONS)]
    won = F.array_compact(F.array(*[F.when(F.col("cells").bitwiseAND(1 << i) != 0, c) for i, c in enumerate(cell)]))
    # Tenths of a percent by whole numbers, so that halves go up whatever a double makes of them.
    pct = lambda a, b: F.coalesce(F.floor(F.try_divide(F.sum(a) * 2000 + F.sum(b), F.sum(b) * 2)) / 10, F.lit(0.0))
    return sums.select("*", F.inline(won)).groupBy("model", "top_k", "fusion", "beta_p").agg(
        pct("exact", "n").alias("exact_match_pct"), pct("right", "chars").alias("char_acc_pct"), pct("firsts", "n").alias("pos0_acc_pct"),
        F.sum("wrong_p").alias("non_p_corrupted"), F.sum("n").alias("evaluated_events"),
    )


def best(found: DataFrame, n: int = 15) -> DataFrame:
    """The n best rows of a matrix by exact plates, then characters; equal ones in the order of the grid."""
    return found.orderBy(F.desc("exact_match_pct"), F.desc("char_acc_pct"), "model", "top_k", "fusion", "beta_p").limit(n)


def largest_crops(crops: DataFrame, by: list[str], size: str, order: list[str], n: int = 5) -> DataFrame:
    """The n crops of each group with the greatest area, their size given as WxH, with their place; the earlier of equal
    ones comes first."""
    side = lambda k: F.regexp_extract(size, r"^(\d+)x(\d+)$", k).try_cast("bigint")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(side(1) * side(2)), *order))
    return crops.withColumn("place", place).where(F.col("place") <= n)
