"""Scans of files: clips, containers, probes, JSON, sheets, frames."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from ..functions import clocks
from ..schema import AUDIT, GROUND_TRUTH, MANIFEST

#: Suffixes in any case.
VIDEO_GLOB = "*.{[mM][pP]4,[aA][vV][iI],[mM][kK][vV],[mM][oO][vV]}"


def video_files(spark: SparkSession, source: str) -> DataFrame:
    """(path, length) of the videos below a folder, or of one file; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", VIDEO_GLOB)
    return reader.load(source).select("path", "length").distinct()


def work_list(files: DataFrame, numbers: list[int] | None = None, most: int | None = None) -> DataFrame:
    """Clips in natural order, of the given numbers if any, the first ones only if a limit is set."""
    rows = files.where(clocks.clip_number(clocks.basename(F.col("path"))).isin(numbers)) if numbers else files
    rows = rows.orderBy(*clocks.natural_key(F.col("path")))
    return rows.limit(most) if most else rows


def file_hashes(spark: SparkSession, source: str) -> DataFrame:
    """(path, length, file_hash): md5 of each file's bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", VIDEO_GLOB)
    return reader.load(source).select("path", "length", F.md5("content").alias("file_hash"))


def box_walk(data: bytes) -> bool:
    """Whether the boxes at a file's top level include the movie header.

    A box has a size of four bytes and a type of four; size 1 means that eight bytes of size follow, 0 or anything under
    8 ends the walk.
    """
    at = 0
    if len(data) < 16:
        return False
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"moov":
            return True
        if size == 1 and at + 16 <= len(data):
            size = struct.unpack_from(">Q", data, at + 8)[0]
        if size < 8:
            break
        at += size
    return False


def playable(path: Column, content: Column) -> Column:
    """Whether a container may be decoded; files other than .mp4 and .mov aren't looked into."""

    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: d is not None and box_walk(bytes(d)))

    return F.when(F.lower(path).rlike(r"\.(mp4|mov)$"), pandas_udf(run, "boolean")(content)).otherwise(True)



def probe_fields(probe: Column) -> dict[str, Column]:
    """codec, pixel format, range, size, rate and number of frames of a probe's JSON text.

    The rate is the average one, or the nominal one, whichever first lies within 10 and 120; else 25.  Without a count
    the frames are duration times rate.
    """
    stream = lambda k: F.get_json_object(probe, f"$.streams[0].{k}")
    ratio = lambda c: F.try_divide(F.try_element_at(F.split(c, "/"), F.lit(1)).cast("double"), F.coalesce(F.try_element_at(F.split(c, "/"), F.lit(2)), F.lit("1")).cast("double"))
    fits = lambda r: F.when(r.between(10, 120), r)
    fps = F.coalesce(fits(ratio(stream("avg_frame_rate"))), fits(ratio(stream("r_frame_rate"))), F.lit(25.0))
    duration = F.coalesce(stream("duration"), F.get_json_object(probe, "$.format.duration")).cast("double")
    return {
        "codec": stream("codec_name"), "pix_fmt": stream("pix_fmt"), "color_range": stream("color_range"),
        "width": stream("width").cast("int"), "height": stream("height").cast("int"), "fps": fps,
        "total_frames": F.coalesce(stream("nb_frames").cast("int"), (duration * fps).cast("int"), F.lit(0)),
    }


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Candidates of one JSON array, or of JSON lines as store.write_records writes them."""
    return spark.read.schema(MANIFEST).option("multiLine", not lines).json(path)


def crop_files(spark: SparkSession, folder: str) -> DataFrame:
    """(event, paths): crops by the event that their names begin with, in the order of names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(folder).select("path")
    event = F.regexp_extract(clocks.basename(F.col("path")), r"^(EVT_\(\d+\)_\d+_\d+)", 1)
    return rows.where(event != "").groupBy(event.alias("event")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def audit_sheet(rows: DataFrame) -> DataFrame:
    """audit_entries of a sheet's rows (row_idx, cells array<string>): plate, type, two times and a note by position;
    rows without a plate are dropped, a missing type is a car."""
    from ..functions import plates

    cell = lambda k: F.nullif(F.trim(F.get("cells", F.lit(k))), F.lit(""))
    plate = F.nullif(F.regexp_replace(F.upper(cell(0)), "[^A-Z0-9]", ""), F.lit(""))
    clock = lambda k: F.when(clocks.time_of_day(cell(k)).isNotNull(), F.date_format(F.timestamp_seconds(clocks.time_of_day(cell(k))), "HH:mm:ss"))
    return rows.where(plate.isNotNull()).select(
        "row_idx", plate.alias("plate_text"), F.coalesce(F.lower(cell(1)), F.lit("car")).alias("vehicle_type"), clock(3).alias("time_cam1"),
        clock(4).alias("time_cam2"), cell(9).alias("note"), F.coalesce(plates.province(plate), F.lit("Desconocida")).alias("province"),
    ).to(AUDIT)


def audit_log(rows: DataFrame) -> DataFrame:
    """(row_idx, plate, vehicle_type, axles, time_cam1, time_cam2, cam2_s, note) of the thirteen-column sheet's rows
    (row_idx, cells); rows with neither a plate nor a second time are dropped.

    cam2_s is the second of the day of two or three numbers with colons between them, null for anything else.
    """
    cell = lambda k: F.get("cells", F.lit(k))
    filled = lambda k: F.coalesce(cell(k) != "", F.lit(False))
    part = lambda k: F.nullif(F.regexp_extract(cell(4), r"^\s*(\d{1,9})\s*:\s*(\d{1,9})\s*(?::\s*(\d{1,9})\s*)?$", k), F.lit("")).cast("int")
    h, m, s = part(1), part(2), F.coalesce(part(3), F.lit(0))
    return rows.where(filled(0) | filled(4)).select(
        "row_idx", F.when(filled(0), F.upper(F.trim(cell(0)))).alias("plate"), F.when(filled(1), F.trim(cell(1))).alias("vehicle_type"), cell(8).alias("axles"),
        F.when(filled(3), cell(3)).alias("time_cam1"), F.when(filled(4), cell(4)).alias("time_cam2"),
        F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s).alias("cam2_s"), F.coalesce(cell(9), F.lit("")).alias("note"),
    )


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_cells(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a workbook's first sheet, with nothing but the standard library."""
    import io

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                letters = "".join(x for x in c.get("r", "A") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [None] * (at - len(cells))
                v = c.find(f"{_NS}v")
                if c.get("t") == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None:
                    cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield int(row.get("r", "0")), cells


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, cells) of the workbooks at a path; each is parsed in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf.content:
                rows = list(sheet_cells(bytes(data)))
                yield pd.DataFrame({"row_idx": [i for i, _ in rows], "cells": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_idx int, cells array<string>")


class _Clip(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FramesReader(DataSourceReader):
    """One partition for each clip; frames are read as they are asked for."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Clip(p) for p in self.options.get("paths", "").split(";") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        height, width = int(self.options["height"]), int(self.options["width"])
        fps, channels = float(self.options.get("fps", 25)), int(self.options.get("channels", 3))
        size, name, idx = height * width * channels, partition.path.rsplit("/", 1)[-1], 0
        with open(partition.path, "rb") as file:
            while len(data := file.read(size)) == size:  # a short read is the end
                yield name, idx, idx / fps, height, width, data
                idx += 1


class FramesSource(DataSource):
    """format("frames"): raw frames of clips as rows; another decoder takes this one's place by the same schema.

    Options: paths (separated by ;), height, width, channels, fps.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "clip_id string, frame_idx int, t_s double, height int, width int, pixels binary"

    def reader(self, schema: T.StructType) -> FramesReader:
        return FramesReader(dict(self.options))
