"""Connected components of an undirected graph of long ids, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, component) of every id in links(a, b); the component is the least id that can be reached.

    Each round takes the least label among a vertex and its neighbours, then the label's own label; labels only fall,
    and the rounds end when none changed.  Every round is written, so nothing is recomputed when an executor is lost.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(both.where("a <> b").distinct(), f"{label}-edges")
    now = scratch.keep(
        edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("component")),
        f"{label}-0",
    )
    k = 0
    while True:
        k += 1
        near = (
            edges.join(now.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        low = now.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        jump = now.select(F.col("id").alias("low"), F.col("component").alias("further"))
        after = low.join(jump, "low", "left").select(
            "id", F.least("low", F.coalesce("further", "low")).alias("component"), "was"
        )
        kept = scratch.keep(after, f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        now = kept.select("id", "component")
        if kept.where("component <> was").isEmpty():
            scratch.drop(f"{label}-edges")
            return now
