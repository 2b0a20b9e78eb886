"""Boxes (x, y, w, h) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).cast(BOX)


def y_overlap(a: Column, b: Column) -> Column:
    """Shared height as a part of the smaller height."""
    shared = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), shared) / F.greatest(F.lit(1e-6), F.least(a["h"], b["h"]))


def overlap_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without an intersection."""
    shared = overlap_area(a, b)
    return F.when(shared > 0, shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared)).otherwise(0.0)


def union_box(boxes: Column) -> Column:
    """The rectangle around an array of boxes."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, below = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return box(x, y, right - x, below - y)


def pad_box(b: Column, ratio: float = 0.12, width: Column | None = None, height: Column | None = None) -> Column:
    """Widen a box by a part of its height; clamped to an image whose size is known, always to y and w of 0 or more."""
    pad = b["h"] * F.lit(ratio)
    x, y, w, h = b["x"] - pad, b["y"] - pad, b["w"] + 2 * pad, b["h"] + 2 * pad
    if width is not None:
        clipped = F.greatest(F.lit(0.0), x)
        x, w = F.when(width.isNull(), x).otherwise(clipped), F.when(width.isNull(), w).otherwise(F.least(width - clipped, w))
    if height is not None:
        clipped = F.greatest(F.lit(0.0), y)
        h = F.when(height.isNull(), h).otherwise(F.least(height - clipped, h))
    return box(x, F.greatest(F.lit(0.0), y), F.greatest(F.lit(0.0), w), h)
