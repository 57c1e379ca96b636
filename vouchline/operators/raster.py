"""Whole images as rows: image, w, h and v, the grey levels of 0 to 255 in one array, row by row.

An image is bounded by its camera and work on it needs no other image, so it stays in one row and in one task: no
pixel is ever shuffled. What is left of it after a step (edge points, runs, histograms) goes on as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchline.functions import homography as hg
from vouchline.functions.geometry import let
from vouchline.operators import stacks


def from_gray(images: DataFrame, key: str, width: str, height: str, values: str) -> DataFrame:
    return images.select(F.col(key).alias("image"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(values).cast("array<int>").alias("v"))


def from_binary(images: DataFrame, key: str, width: str, height: str, channels: str, data: str) -> DataFrame:
    """From unsigned bytes of one, three (blue, green, red) or four channels, as decoded image files hold them."""
    levels = F.transform(F.sequence(F.lit(1), F.col(width) * F.col(height) * F.col(channels)), lambda i: F.ascii(F.decode(F.col(data).substr(i, F.lit(1)), F.lit("ISO-8859-1"))))
    read = images.select(F.col(key).alias("image"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(channels).cast("int").alias("c"), levels.alias("l"))
    at = lambda i, k: F.get("l", i * F.col("c") + k)
    gray = F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.when(F.col("c") < 3, at(i, 0)).otherwise(F.rint(0.114 * at(i, 0) + 0.587 * at(i, 1) + 0.299 * at(i, 2)).cast("int")))
    return read.select("image", "w", "h", gray.alias("v"))


def _places(w: Column, h: Column) -> Column:
    return F.sequence(F.lit(0), w * h - 1)


def gaussian_weights(size: int, sigma: float | None = None) -> list[float]:
    """Of an odd window; without sigma the width that the size implies."""
    import math

    s = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * s * s)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def blur(rasters: DataFrame, size: int, sigma: float | None = None) -> DataFrame:
    """Gaussian mean over size x size pixels, one axis after the other, mirrored at the border, rounded once at the end."""
    weights = gaussian_weights(size, sigma)
    return stacks.replaced(rasters, "v", lambda v: stacks.blurred(v, weights))


def warp(rasters: DataFrame, matrix: str, w: int, h: int) -> DataFrame:
    """The w x h image whose pixel is the source's value, between its four neighbours, where the row's own map takes it.

    ``matrix`` leads from the new image to the old one; what lies outside the old one is 0. A row without a map gives
    a null image.
    """

    def value(i: Column) -> Column:
        return let(hg.apply(F.col(matrix), (i % w).cast("double"), F.floor(i / w).cast("double")), between)

    def between(p: Column) -> Column:
        x0, y0 = F.floor(p["x"]), F.floor(p["y"])
        inside = lambda x, y: (x >= 0) & (x < F.col("w")) & (y >= 0) & (y < F.col("h"))
        at = lambda x, y: F.when(inside(x, y), F.get("v", (y * F.col("w") + x).cast("int"))).otherwise(0)
        fx, fy = p["x"] - x0, p["y"] - y0
        mixed = (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy
        return F.rint(F.round(F.coalesce(mixed, F.lit(0.0)), 6)).cast("int")

    out = F.when(F.col(matrix).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), value))
    return rasters.withColumn("__v", out).select(*(c for c in rasters.columns if c not in ("w", "h", "v")), F.lit(w).alias("w"), F.lit(h).alias("h"), F.col("__v").alias("v"))


def histogram(rasters: DataFrame) -> DataFrame:
    """image, v, n: counted in the row's own task before anything is grouped."""
    return rasters.select("image", F.explode("v").alias("v")).groupBy("image", "v").agg(F.count(F.lit(1)).alias("n"))
