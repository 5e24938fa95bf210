"""Best frames and crops of each track."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings


def top(rows: DataFrame, by: list[str], score: str, arrival: list[str], most: int, name: str = "rank") -> DataFrame:
    """The best rows of each group, earlier ones first on ties; Spark limits each partition before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *arrival)
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def top_vehicles(frames: DataFrame, by: list[str], arrival: list[str], s: Settings = DEFAULT) -> DataFrame:
    if s.separation_seconds > 0:
        return top_apart(frames, by, arrival, s.top_vehicles, s.separation_seconds)
    return top(frames, by, "score", arrival, s.top_vehicles)


def top_plates(crops: DataFrame, by: list[str], arrival: list[str], s: Settings = DEFAULT) -> DataFrame:
    return top(crops, by, "score", arrival, s.top_plates)


def top_apart(frames: DataFrame, by: list[str], arrival: list[str], most: int, apart: float) -> DataFrame:
    """The best frames, no two closer in time than `apart`, as they stand after each arrival: a frame near a kept one
    replaces it only if it scores better.  Sequential within a group, and bounded by `most` frames."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(arrival, kind="stable").reset_index(drop=True)
        kept: list[tuple[float, float, int]] = []  # score, time, row; best first
        for k, (score, t) in enumerate(zip(pdf.score, pdf.t_s, strict=True)):
            close = next((j for j, (_, other, _) in enumerate(kept) if abs(t - other) < apart), None)
            if close is None:
                kept.append((score, t, k))
            elif score > kept[close][0]:
                kept[close] = (score, t, k)
            else:
                continue
            kept = sorted(kept, key=lambda x: -x[0])[:most]
        out = pdf.iloc[[k for *_, k in kept]]
        return out.assign(rank=range(1, len(out) + 1))

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in frames.schema.fields)}, rank int"
    return frames.groupBy(*by).applyInPandas(fold, schema)


def votes_list(reads: DataFrame, by: list[str], *ties: str) -> DataFrame:
    """(by, votes): texts with rounded confidence, surest first, then by plate score, then by the tie columns."""
    entry = F.struct(
        (-F.col("ocr_conf")).alias("a"), (-F.col("plate_score")).alias("b"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(ties)],
        F.col("text"), F.round("ocr_conf", 3).alias("conf"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda v: F.struct(v["text"].alias("text"), v["conf"].alias("conf")))
    return reads.groupBy(*by).agg(F.to_json(ordered).alias("votes"))
