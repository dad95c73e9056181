"""Warps of gray images as gathers: each pixel is read where an inverse map sends it, between the pixels of the row's own array.

Places are bilinear and rounded half to even; outside, the edge goes on. A map gives the place (row, column) for (row, column, height, width) as
Columns, so one expression serves turns by any angle and fields of displacements. Angles and strengths come from hashes of seed and id.

Defined cases: an image without pixels stays empty; a null array stays null; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.vectors import let, span

Map = Callable[[Column, Column, Column, Column], tuple[Column, Column]]


def drawn(key: str, seed: int, low: float, high: float) -> Column:
    """A number between low and high for each key, by hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("double")
    return low + (high - low) * bits / float(1 << 32)


def warped(images: DataFrame, to: Map) -> DataFrame:
    """Rows of (height, width, px) with px read through the map."""
    h, w, px = F.col("height"), F.col("width"), F.col("px")
    inside = lambda x, n: F.least(F.greatest(x.cast("double"), F.lit(0.0)), (n - 1).cast("double"))

    def value(p: Column) -> Column:
        r, c = F.floor(p["r"]).cast("int"), F.floor(p["c"]).cast("int")
        fr, fc, r2, c2 = p["r"] - r, p["c"] - c, F.least(r + 1, h - 1), F.least(c + 1, w - 1)
        at = lambda i, j: F.get(px, i * w + j).cast("double")
        return F.bround((at(r, c) * (1 - fc) + at(r, c2) * fc) * (1 - fr) + (at(r2, c) * (1 - fc) + at(r2, c2) * fc) * fr, 0).cast("int")

    def pixel(i: Column) -> Column:
        r, c = to(F.floor(i / w), i % w, h, w)
        return let(F.struct(inside(r, h).alias("r"), inside(c, w).alias("c")), value)

    return images.withColumn("px", F.when(F.size(px) > 0, F.transform(span(h * w), pixel)).otherwise(px))


def rotated(images: DataFrame, degrees: Column) -> DataFrame:
    """Turned anticlockwise about the pixel at (height // 2, width // 2)."""
    a = degrees * (math.pi / 180)

    def to(r: Column, c: Column, h: Column, w: Column) -> tuple[Column, Column]:
        middle, centre = F.floor(h / 2), F.floor(w / 2)
        y, x = r - middle, c - centre
        return middle + y * F.cos(a) + x * F.sin(a), centre + x * F.cos(a) - y * F.sin(a)

    return warped(images, to)


def bulged(images: DataFrame, strength: Column) -> DataFrame:
    """Radial distortion: places move away from the middle, or towards it, with the square of their distance."""

    def to(r: Column, c: Column, h: Column, w: Column) -> tuple[Column, Column]:
        y, x = (r - h / 2) / h, (c - w / 2) / w
        f = 1 + strength * (x * x + y * y)
        return h / 2 + y * f * h, w / 2 + x * f * w

    return warped(images, to)
