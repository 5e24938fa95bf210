"""Where detectors, recognisers and decoders plug in.

A model is an object made once in each task by a factory; it sees batches and returns frames of a fixed schema.  Several
factories can be given: the first that loads is used, so an accelerated runtime can fall back to a plain one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTIONS = "det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, class_id int"
READINGS = "ord int, text string, ocr_conf double, char_confs array<double>"


class Detector(Protocol):
    def __call__(self, frames: pd.DataFrame) -> list[list[tuple]]:
        """For each frame its boxes, as tuples of DETECTIONS without det_idx."""


class Recognizer(Protocol):
    def __call__(self, crops: pd.DataFrame) -> list[list[tuple]]:
        """For each crop its readings, as tuples of READINGS without ord."""


def first_loaded(factories: list[Callable]) -> tuple[object, int]:
    """The model of the first factory that works, and its place; all errors are told if none does."""
    errors = []
    for k, factory in enumerate(factories):
        try:
            return factory(), k
        except Exception as e:  # noqa: BLE001  whatever a runtime raises when it can't load
            errors.append(f"{k}: {type(e).__name__}: {e}")
    raise RuntimeError("no model could be loaded: " + "; ".join(errors))


def _applied(rows: DataFrame, factories: list[Callable], keys: list[str], made: str) -> DataFrame:
    names = [c.split()[0] for c in made.replace("array<double>", "x").split(", ")]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if model is None:
                model, _ = first_loaded(factories)
            out, error = [], None
            try:
                results = model(pdf)
            except Exception as e:  # noqa: BLE001  one bad batch is told in its rows and doesn't end the job
                results, error = [[] for _ in range(len(pdf))], f"{type(e).__name__}: {e}"[:200]
            for key, found in zip(pdf[keys].itertuples(index=False), results, strict=True):
                if error:
                    out.append((*key, *[None] * len(names), error))
                out += [(*key, k, *x, None) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=[*keys, *names, "error"])

    return rows.mapInPandas(run, f"{kinds}, {made}, error string")


def detect(frames: DataFrame, factories: list[Callable[[], Detector]], keys: list[str]) -> DataFrame:
    """(keys, DETECTIONS, error) of each frame; put cheap filters such as the sampling gate before it."""
    return _applied(frames, factories, keys, DETECTIONS)


def read_plates(crops: DataFrame, factories: list[Callable[[], Recognizer]], keys: list[str]) -> DataFrame:
    """(keys, READINGS, error) of each crop; limit the crops of an event before it."""
    return _applied(crops, factories, keys, READINGS)


def failed_clips(clips: DataFrame, error: str = "error") -> DataFrame:
    """clips with their status: COMPLETED, CORRUPTED where the container can't be opened, else FAILED with the cause."""
    cause = F.col(error)
    status = F.when(cause.isNull(), "COMPLETED").when(cause.startswith("corrupt"), "CORRUPTED").otherwise(F.concat(F.lit("FAILED: "), F.substring(cause, 1, 50)))
    return clips.withColumn("status", status)
