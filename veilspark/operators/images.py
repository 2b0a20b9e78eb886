"""Obfuscation of image regions: the plan as column expressions, the pixels with numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..config import ScanConfig
from .detect import candidates

#: Blur radius by severity, growth per attempt, attempts, and radii of frost and redaction.
RADIUS, GROWTH, ATTEMPTS, FROST, REDACT = {"low": 8.0, "medium": 12.0, "high": 18.0, "critical": 24.0}, 0.6, 3, 14.0, 12.0
BLOCKS, INK, GLASS = 6, (17, 24, 39), 90 / 255
#: Pixels of a side up to which its blur is one product, also where the kernel is shorter.
SHORT_SIDE = 64
#: A region is protected when its detail has fallen to this, absolute or as a part.
DETAIL_LEFT, DETAIL_PART = 1.5, 0.35


def protection_plan(severity: Column, mode: Column, attempt: Column) -> Column:
    """What happens to a region: (action, radius, blocks); blocks is 0 where nothing is pixelated."""
    strength = F.lit(1.0) + GROWTH * (attempt - 1)
    blocks = F.greatest(F.lit(2), F.floor(F.lit(BLOCKS) / strength).cast("int"))
    critical = severity == "critical"
    action = F.when(critical | (mode == "frosted"), "frost").when(mode.isin("redact", "pixelate"), mode).otherwise("blur")
    base = F.coalesce(*[F.when(severity == k, v) for k, v in RADIUS.items()], F.lit(12.0))
    radius = F.when(action == "frost", FROST).when(action == "redact", REDACT).when(action == "pixelate", 0.0).otherwise(base * strength)
    return F.struct(action.alias("action"), F.round(radius, 6).alias("radius"), F.when((critical & (attempt > 1)) | (action == "pixelate"), blocks).otherwise(0).alias("blocks"))


def is_protected(before: Column, after: Column, left_over: Column | None = None) -> Column:
    """Whether a region is safe: where text was read again nothing of the type may be left, else its detail must have gone."""
    structural = (before <= 1e-6) | (after <= F.greatest(F.lit(DETAIL_LEFT), before * DETAIL_PART))
    return structural if left_over is None else F.when(left_over.isNotNull(), left_over == 0).otherwise(structural)


@lru_cache(maxsize=64)
def _weights(size: int, radius: float) -> np.ndarray:
    """The blur of a line of so many pixels as a matrix: what falls beyond an edge counts for the pixel at the edge."""
    kernel = _kernel(radius)
    reach, out = len(kernel) // 2, np.zeros((size, size))
    for i in range(size):
        np.add.at(out[i], np.clip(np.arange(i - reach, i + reach + 1), 0, size - 1), kernel)
    return out


def _kernel(radius: float) -> np.ndarray:
    reach = max(1, int(3 * radius))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    return kernel / kernel.sum()


def blur(pixels: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur; edges repeat. A side that the kernel reaches over is blurred by one product, so the work is that of its pixels."""
    kernel = _kernel(radius)
    reach = len(kernel) // 2
    out = pixels.astype(float)
    for axis in (0, 1):
        size = out.shape[axis]
        if 0 < size <= max(SHORT_SIDE, len(kernel)):
            out = np.moveaxis(np.tensordot(_weights(size, radius), out, (1, axis)), 0, axis)
            continue
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
        out = sum(k * np.take(padded, range(i, i + size), axis=axis) for i, k in enumerate(kernel))
    return out


def pixelate(pixels: np.ndarray, blocks: int) -> np.ndarray:
    """Means of a grid of so many columns, and rows in proportion."""
    h, w = pixels.shape[:2]
    rows, cols = max(1, blocks * h // max(1, w)), max(1, blocks)
    r, c = np.minimum(np.arange(h) * rows // h, rows - 1), np.minimum(np.arange(w) * cols // w, cols - 1)
    cell = r[:, None] * cols + c[None, :]
    n = np.maximum(np.bincount(cell.ravel(), minlength=rows * cols), 1)
    flat = pixels.reshape(h * w, -1).astype(float)
    means = np.stack([np.bincount(cell.ravel(), weights=flat[:, k], minlength=rows * cols) / n for k in range(flat.shape[1])], axis=1)
    return means[cell].reshape(pixels.shape)


def detail(pixels: np.ndarray) -> float:
    """How much structure a region shows: the mean difference to itself, slightly blurred."""
    grey = pixels @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels.astype(float)
    return float(np.abs(grey - blur(grey, 1.0)).mean()) if grey.size else 0.0


def region(image: np.ndarray, box: tuple[float, float, float, float]) -> tuple[slice, slice] | None:
    """The whole pixels of a box inside the image, None if there are none."""
    x, y, w, h = box
    x1, y1, x2, y2 = max(0, int(x)), max(0, int(y)), min(image.shape[1], int(x + w)), min(image.shape[0], int(y + h))
    return (slice(y1, y2), slice(x1, x2)) if x2 > x1 and y2 > y1 else None


def protect(image: np.ndarray, box: tuple, severity: str, mode: str, attempt: int = 1) -> None:
    """Obfuscate one region of an RGB image in place; later attempts act on what earlier ones left."""
    at = region(image, box)
    if at is None:
        return
    strength, pixels = 1 + GROWTH * (attempt - 1), image[at].astype(float)
    blocks = max(2, int(BLOCKS / strength))
    if severity == "critical" or mode == "frosted":
        pixels = blur(pixels, FROST) * (1 - GLASS) + 255 * GLASS
        if severity == "critical" and attempt > 1:
            pixels = pixelate(pixels, blocks)
    elif mode == "redact":
        pixels = np.broadcast_to(np.array(INK, float), pixels.shape)
    elif mode == "pixelate":
        pixels = pixelate(pixels, blocks)
    else:
        pixels = blur(pixels, RADIUS.get(severity, 12.0) * strength)
    image[at] = np.clip(np.rint(pixels), 0, 255).astype(image.dtype)


def protect_and_verify(image: np.ndarray, box: tuple, severity: str, mode: str, leaks: Callable[[np.ndarray], bool] | None = None) -> tuple[int, bool]:
    """Protect a region until it is safe: (attempts, safe). leaks tells from the pixels whether the value can still be read."""
    at = region(image, box)
    before = detail(image[at]) if at else 0.0
    for attempt in range(1, ATTEMPTS + 1):
        protect(image, box, severity, mode, attempt)
        now = image[at] if at else np.zeros((1, 1, 3))
        safe = not leaks(now) if leaks else before <= 1e-6 or detail(now) <= max(DETAIL_LEFT, DETAIL_PART * before)
        if safe:
            return attempt, True
    return ATTEMPTS, False


def protect_images(images: DataFrame, mode: str = "blur") -> DataFrame:
    """Images with their regions obfuscated: ``image_id, data, attempts, verified``.

    images: image_id long, height, width int, data binary (RGB, row by row), boxes array of (x, y, w, h, severity).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, w, data, boxes in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["data"], pdf["boxes"], strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3).copy()
                done = [protect_and_verify(image, (b["x"], b["y"], b["w"], b["h"]), b["severity"], mode) for b in (boxes if boxes is not None else ())]
                rows.append((i, image.tobytes(), [n for n, _ in done], [ok for _, ok in done]))
            yield pd.DataFrame(rows, columns=["image_id", "data", "attempts", "verified"])

    return images.select("image_id", "height", "width", "data", "boxes").mapInPandas(run, "image_id long, data binary, attempts array<int>, verified array<boolean>")


def png(image: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 3)], axis=1)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes())), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)


@F.pandas_udf(BinaryType())
def png_of(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """RGB bytes as PNG files; null stays null."""
    return pd.Series([None if d is None else png(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)) for d, h, w in zip(data, height, width, strict=True)])


def _attempt(mode: str, read: Callable[[np.ndarray], str] | None, attempt: int) -> Callable[..., Column]:
    """One attempt at the regions that are not safe yet: the image, detail before the first attempt and now, and what can still be read."""

    def again(pixels: np.ndarray, kind: str) -> str | None:
        if read is None or kind == "CUSTOM_PATTERN":
            return None
        try:
            return read(pixels)
        except Exception:  # a reader that fails says nothing of the region, so its detail decides
            return None

    def one(h: float, w: float, data: bytes | None, boxes: np.ndarray, before: np.ndarray | None, attempts: np.ndarray, safe: np.ndarray) -> tuple:
        if data is None or all(safe):
            return data, before, None, None, attempts
        image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3).copy()
        first, now, left = [0.0] * len(boxes) if before is None else list(before), [0.0] * len(boxes), [None] * len(boxes)
        for i, b in enumerate(boxes):
            box = (b["x"], b["y"], b["w"], b["h"])
            at = region(image, box)
            if safe[i] or at is None:
                continue
            if before is None:
                first[i] = detail(image[at])
            protect(image, box, b["severity"], mode, attempt)
            now[i], left[i] = detail(image[at]), again(image[at], b["type"])
        return image.tobytes(), first, now, left, [n if ok else attempt for n, ok in zip(attempts, safe, strict=True)]

    def run(height: pd.Series, width: pd.Series, data: pd.Series, boxes: pd.Series, before: pd.Series, attempts: pd.Series, safe: pd.Series) -> pd.DataFrame:
        rows = [one(*row) for row in zip(height, width, data, boxes, before, attempts, safe, strict=True)]
        return pd.DataFrame(rows, columns=["data", "before", "after", "left", "attempts"])

    # opaque to the optimizer, which might otherwise copy it to each of its uses
    return F.pandas_udf(run, "data binary, before array<double>, after array<double>, left array<string>, attempts array<int>").asNondeterministic()


def protect_regions(df: DataFrame, cfg: ScanConfig, read: Callable[[np.ndarray], str] | None = None) -> DataFrame:
    """df with ``data`` obfuscated in its ``regions``, and ``attempts`` and ``verified``, arrays in their order.

    df: height, width int, data binary (RGB, row by row; null: no image), regions array of ``spatial.LOCATED``, not null. Each region is
    protected up to three times, each time on what the last one left, until it is safe. ``read`` tells the text in the pixels of a
    region: it is safe once no candidate of its type is left there. Without it, where it fails, and for users' patterns, its detail must have
    gone. A region without extent, or of a row without image, is not touched and counts as safe. A round goes over all regions
    before the next begins, which only matters where regions overlap.
    """
    known = replace(cfg, custom=())
    boxes = F.transform("regions", lambda r: F.struct(r["type"].alias("type"), r["severity"].alias("severity"), *[r["box"][n].alias(n) for n in "xywh"]))
    nothing = lambda r: F.col("data").isNull() | ~((r["box"]["w"] > 0) & (r["box"]["h"] > 0))
    df = df.withColumns({"_before": F.lit(None).cast("array<double>"), "verified": F.transform("regions", nothing), "attempts": F.transform("regions", lambda r: F.lit(1))})

    def left_over(i: Column) -> Column | None:
        text = F.get("_r.left", i)
        if read is None:
            return None
        return F.when(text.isNotNull(), F.size(F.filter(candidates(text, known), lambda c: c["type"] == F.get("regions", i)["type"])))

    for attempt in range(1, ATTEMPTS + 1):
        safe = F.transform("verified", lambda ok, i: ok | F.coalesce(is_protected(F.get("_r.before", i), F.get("_r.after", i), left_over(i)), F.lit(False)))
        df = df.withColumn("_r", _attempt(cfg.mode, read, attempt)("height", "width", "data", boxes, "_before", "attempts", "verified"))
        df = df.withColumns({"data": F.col("_r.data"), "_before": F.col("_r.before"), "attempts": F.col("_r.attempts"), "verified": safe})
    return df.drop("_before", "_r")
