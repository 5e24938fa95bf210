"""Images made from images: letterboxes, smaller planes, contact sheets, and PNG bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour."""
    return image[(np.arange(height) * image.shape[0] // height)[:, None], np.arange(width) * image.shape[1] // width]


def letterboxed(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image scaled to fit, in the middle of black."""
    scale = min(width / image.shape[1], height / image.shape[0])
    h, w = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    out = np.zeros((height, width, *image.shape[2:]), np.uint8)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = resized(image, h, w)
    return out


def shrunk_nv12(data: bytes, height: int, width: int, new_height: int, new_width: int) -> bytes:
    """Luma and interleaved chroma planes, each scaled on its own; sides must be even."""
    flat = np.frombuffer(data, np.uint8)
    y = flat[: height * width].reshape(height, width)
    uv = flat[height * width :].reshape(height // 2, width // 2, 2)
    return resized(y, new_height, new_width).tobytes() + resized(uv, new_height // 2, new_width // 2).tobytes()


def png(image: np.ndarray) -> bytes:
    """PNG bytes of a gray or blue-green-red image."""
    rgb = image if image.ndim == 2 else image[..., ::-1]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgb))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def contact_sheet(images: list[np.ndarray], columns: int, height: int, width: int) -> np.ndarray:
    """Letterboxed images in rows."""
    tiles = [letterboxed(i, height, width) for i in images]
    tiles += [np.zeros_like(tiles[0])] * (-len(tiles) % columns) if tiles else []
    return np.concatenate([np.concatenate(tiles[k : k + columns], axis=1) for k in range(0, len(tiles), columns)])


def as_png(data: Column, height: Column, width: Column) -> Column:
    """PNG bytes of BGR pixels; null where there are none."""

    def run(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if not d else png(np.frombuffer(d, np.uint8).reshape(int(a), int(b), 3)) for d, a, b in zip(p, h, w, strict=True)])

    return pandas_udf(run, "binary")(data, height, width)


def evidence(events: DataFrame) -> DataFrame:
    """(event_id, vehicle_crop_path, plate_crop_path, vehicle_png, plate_png): the names and contents of an event's
    pictures; the plate's name is null without a plate crop."""
    name = lambda kind: F.concat("event_id", F.lit(f"_{kind}.png"))
    return events.select(
        "event_id", name("veh").alias("vehicle_crop_path"), F.when(F.col("plate_pixels").isNotNull(), name("plate")).alias("plate_crop_path"),
        as_png(F.col("vehicle_pixels"), F.col("vehicle_h"), F.col("vehicle_w")).alias("vehicle_png"),
        as_png(F.col("plate_pixels"), F.coalesce("plate_h", F.lit(0)), F.coalesce("plate_w", F.lit(0))).alias("plate_png"),
    )


def write_evidence(events: DataFrame, folder: str) -> DataFrame:
    """(event_id, vehicle_crop_path, plate_crop_path) of evidence(), whose pictures are written below a folder that all
    executors share, given as a URI or an absolute path; null where an event has no such picture.

    Executors write the files of their own rows when the result is read, each to a name of its own and then moved, so a
    task that runs again or twice leaves whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def put(name: str | None, data: bytes | None) -> str | None:
            if not name or not data:
                return None
            part = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(data)
            store.move(part, f"{root}/{name}")
            return f"{folder.rstrip('/')}/{name}"

        for b in batches:
            yield pd.DataFrame({
                "event_id": b.event_id,
                "vehicle_crop_path": [put(n, d) for n, d in zip(b.vehicle_crop_path, b.vehicle_png, strict=True)],
                "plate_crop_path": [put(n, d) for n, d in zip(b.plate_crop_path, b.plate_png, strict=True)],
            })

    return evidence(events).mapInPandas(run, "event_id string, vehicle_crop_path string, plate_crop_path string")
