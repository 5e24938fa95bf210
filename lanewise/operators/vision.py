"""Image measures in Arrow-batched numpy: motion, sharpness, exposure, histograms, conversion, differences, clock digits.

Images are BINARY columns of rows x columns (x 3, blue first) unsigned bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Full-range luma for BGR, thumbnail, thresholds.
BGR = (0.114, 0.587, 0.299)
THUMB_W, THUMB_H, MOVED, MOTION_RATIO, BRIGHT = 128, 72, 18, 0.005, 248


def _image(data: bytes | None, height: int, width: int) -> np.ndarray | None:
    if not data or height <= 0 or width <= 0:
        return None
    flat = np.frombuffer(data, np.uint8)
    if flat.size == height * width * 3:
        return flat.reshape(height, width, 3)
    return flat[: height * width].reshape(height, width) if flat.size >= height * width else None


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.floor(image @ np.array(BGR) + 0.5).astype(np.uint8)


def _each(measure):
    def run(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([measure(_image(d, int(h), int(w))) for d, h, w in zip(data, height, width, strict=True)])

    return run


def _laplacian_variance(image: np.ndarray | None) -> float:
    if image is None or not image.size:
        return 0.0
    g = np.pad(gray(image).astype(np.float64), 1, mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def _overexposed(image: np.ndarray | None) -> float:
    if image is None or not image.size:
        return 1.0
    return float(min(1.0, 2 * (gray(image) > BRIGHT).mean()))


def _hs_histogram(image: np.ndarray | None) -> list[float] | None:
    """30 x 32 bins of hue and saturation."""
    if image is None or image.ndim != 3 or not image.size:
        return None
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = high - low
    safe = np.where(span > 0, span, 1)
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(span > 0, hue * 30 % 180, 0)
    saturation = np.where(high > 0, 255 * span / np.where(high > 0, high, 1), 0)
    counts, *_ = np.histogram2d(hue.ravel(), saturation.ravel(), bins=(30, 32), range=((0, 180), (0, 256)))
    return counts.ravel().tolist()


def _thumbnail(image: np.ndarray) -> np.ndarray:
    g = gray(image)
    if image.ndim == 2 and g.shape[0] % 3 == 0:  # luma and chroma rows in one plane: the upper two thirds are luma
        g = g[: g.shape[0] * 2 // 3]
    return g[(np.arange(THUMB_H) * g.shape[0] // THUMB_H)[:, None], np.arange(THUMB_W) * g.shape[1] // THUMB_W]


def sharpness(data: Column, height: Column, width: Column) -> Column:
    """Variance of the Laplacian; 0 for an empty image."""
    return pandas_udf(_each(_laplacian_variance), "double")(data, height, width)


def overexposure(data: Column, height: Column, width: Column) -> Column:
    """Twice the share of pixels brighter than 248, at the most 1; 1 for an empty image."""
    return pandas_udf(_each(_overexposed), "double")(data, height, width)


def histogram(data: Column, height: Column, width: Column) -> Column:
    """Counts of hue and saturation for the comparison of looks; null for an empty image."""
    return pandas_udf(_each(_hs_histogram), "array<double>")(data, height, width)


def motion(data: Column, before: Column, height: Column, width: Column) -> Column:
    """Whether enough of a thumbnail differs from the frame before (lag() gives it); false for the first frame."""

    def run(now: pd.Series, last: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for a, b, x, y in zip(now, last, h, w, strict=True):
            p, q = _image(a, int(x), int(y)), _image(b, int(x), int(y))
            moved = 0.0 if p is None or q is None else (np.abs(_thumbnail(p).astype(int) - _thumbnail(q)) > MOVED).mean()
            out.append(bool(moved >= MOTION_RATIO))
        return pd.Series(out)

    return pandas_udf(run, "boolean")(data, before, height, width)


def nv12_to_bgr(data: Column, height: Column, width: Column) -> Column:
    """BGR bytes of full-range frames with interleaved chroma at half size; null if the sizes don't fit."""

    def convert(raw: bytes | None, h: int, w: int) -> bytes | None:
        if not raw or len(raw) != h * w * 3 // 2:
            return None
        flat = np.frombuffer(raw, np.uint8)
        y = flat[: h * w].reshape(h, w).astype(np.float64)
        uv = flat[h * w :].reshape(h // 2, w // 2, 2).repeat(2, axis=0).repeat(2, axis=1).astype(np.float64) - 128
        u, v = uv[..., 0], uv[..., 1]
        out = np.stack([y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v], axis=-1)
        return np.clip(np.round(out), 0, 255).astype(np.uint8).tobytes()

    def run(raw: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([convert(a, int(x), int(y)) for a, x, y in zip(raw, h, w, strict=True)])

    return pandas_udf(run, "binary")(data, height, width)


def difference(a: Column, b: Column, height: Column, width: Column) -> Column:
    """Struct of mean absolute error, root mean square error, greatest error and both mean lumas of two images, and of
    each channel's mean absolute error."""

    def run(x: pd.Series, y: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q, n, m in zip(x, y, h, w, strict=True):
            i, j = _image(p, int(n), int(m)), _image(q, int(n), int(m))
            if i is None or j is None or i.shape != j.shape:
                rows.append((None,) * 8)
                continue
            d = i.astype(np.float64) - j
            rows.append((np.abs(d).mean(), (d * d).mean() ** 0.5, np.abs(d).max(), gray(i).mean(), gray(j).mean(), *np.abs(d).mean(axis=(0, 1))))
        return pd.DataFrame(rows, columns=["mae", "rmse", "max", "luma_a", "luma_b", "mae_b", "mae_g", "mae_r"])

    return pandas_udf(run, "mae double, rmse double, max double, luma_a double, luma_b double, mae_b double, mae_g double, mae_r double")(a, b, height, width)


def clock_digits(data: Column, height: Column, width: Column, templates: dict[str, np.ndarray], slots: list[tuple[int, int, int, int]], least: float = 0.80) -> Column:
    """Text of an on-screen clock: in each slot (x, y, w, h) the digit whose template correlates best, null if any slot
    has no digit that correlates well enough."""
    names = sorted(templates)
    shapes = {(w, h) for *_, w, h in slots}
    ready = {}
    for w, h in shapes:
        rows = []
        for n in names:
            t = templates[n]
            t = t[(np.arange(h) * t.shape[0] // h)[:, None], np.arange(w) * t.shape[1] // w].astype(np.float64)
            t = t - t.mean()
            rows.append((t / max(1e-9, np.linalg.norm(t))).ravel())
        ready[w, h] = np.stack(rows)

    def read(image: np.ndarray | None) -> str | None:
        if image is None:
            return None
        mask, out = (gray(image) > 180).astype(np.float64), ""
        for x, y, w, h in slots:
            part = mask[y : y + h, x : x + w]
            if part.shape != (h, w):
                return None
            part = (part - part.mean()).ravel()
            scores = ready[w, h] @ (part / max(1e-9, np.linalg.norm(part)))
            if scores.max() < least:
                return None
            out += names[int(scores.argmax())]
        return out

    return pandas_udf(_each(read), "string")(data, height, width)


def clock_time(digits: Column) -> Column:
    """The moment of 14 digits (year to second); null for none or an impossible date."""
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
