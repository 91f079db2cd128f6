"""Sizes of images and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def multiple_of_16(x: Column) -> Column:
    """Nearest multiple of 16, ties to the even multiple."""
    return (F.bround(x / 16.0) * 16).cast("int")


def multiple_of_8(n: Column) -> Column:
    """Nearest multiple of 8, ties up."""
    return F.when(n % 8 >= 4, n + (8 - n % 8)).otherwise(n - n % 8).cast("int")


def ceil_to(x: Column, m: int) -> Column:
    return (F.ceil(x / float(m)) * m).cast("int")


def floor_to(x: Column, m: int) -> Column:
    return (F.floor(x / float(m)) * m).cast("int")


def area_resize(w: Column, h: Column, size: int = 512) -> Column:
    """Width and height of about size*size pixels at the same ratio, down to multiples of 16; the longer side is found first."""
    r = w / h
    wide = F.ceil(F.sqrt(F.lit(float(size * size)) * r))
    tall = F.ceil(F.sqrt(F.lit(float(size * size)) / r))
    return F.when(w > h, F.struct(floor_to(wide, 16).alias("w"), floor_to(F.ceil(wide / r), 16).alias("h"))).otherwise(
        F.struct(floor_to(F.ceil(tall * r), 16).alias("w"), floor_to(tall, 16).alias("h"))
    )


def shorter_side_resize(w: Column, h: Column, size: int = 512) -> Column:
    """Sizes with the shorter side at `size`, before a centre crop."""
    wide = F.floor(w * size / h).cast("int")
    return F.when(wide >= size, F.struct(wide.alias("w"), F.lit(size).alias("h"))).otherwise(F.struct(F.lit(size).alias("w"), F.floor(h * size / w).cast("int").alias("h")))


def cover_resize(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    """Smallest sizes at the same ratio that cover a bucket."""
    scale = F.greatest(bw / w, bh / h)
    return F.struct(F.greatest(bw, F.bround(w * scale).cast("int")).alias("w"), F.greatest(bh, F.bround(h * scale).cast("int")).alias("h"))


def concat_direction(h: Column, w: Column) -> Column:
    return F.when(h > w, "horizontal").otherwise("vertical")


def merged_size(widths: Column, heights: Column, gap: int = 10) -> Column:
    """Width and height of images side by side at their average height."""
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    mean = F.floor(F.aggregate(heights, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(heights)).cast("int")
    return F.struct((total + gap * (F.size(widths) - 1)).cast("int").alias("w"), mean.alias("h"))


def box_corners(cx: Column, cy: Column, bw: Column, bh: Column, w: Column, h: Column) -> Column:
    """Corners of a box given by its centre and size as shares of the image."""
    return F.struct(((cx - bw / 2) * w).alias("x0"), ((cy - bh / 2) * h).alias("y0"), ((cx + bw / 2) * w).alias("x1"), ((cy + bh / 2) * h).alias("y1"))


def polygon(c: Column) -> Column:
    """Points of "(x,y) (x,y) ..."."""
    xs = F.regexp_extract_all(c, F.lit(r"\((-?\d+)\s*,\s*(-?\d+)\)"), F.lit(1))
    ys = F.regexp_extract_all(c, F.lit(r"\((-?\d+)\s*,\s*(-?\d+)\)"), F.lit(2))
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def top_left_order(regions: Column) -> Column:
    """Regions (x, y, ...) from top to bottom, then left to right."""
    return F.transform(F.array_sort(F.transform(regions, lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r.alias("r")))), lambda s: s["r"])


def area_band(area: Column) -> Column:
    """0 small, 1 medium, 2 large."""
    return F.when(area < 32 * 32, 0).when(area < 96 * 96, 1).otherwise(2)


def denormalised(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean
