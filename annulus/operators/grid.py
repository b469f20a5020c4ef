"""Stencils and resampling of pixel tables (y, x, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cubic B-spline kernel in sixteenths.
B3 = (1, 4, 6, 4, 1)


def smoothed(pixels: DataFrame, kernel: dict[int, float]) -> DataFrame:
    """Normalised convolution by a kernel (offset: weight) along x and then y; missing pixels carry no weight.

    Each pixel sends its weighted value to its neighbours and sums meet by position, in two grouped passes.
    """
    p = pixels.select("y", "x", F.col("value").alias("s"), F.lit(1.0).alias("w")).where("s is not null")
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(k)).alias("k")) for o, k in kernel.items()])
    for axis in ("x", "y"):
        p = p.withColumn("t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("t.o"))
        p = p.groupBy("y", "x").agg(F.sum(F.col("s") * F.col("t.k")).alias("s"), F.sum(F.col("w") * F.col("t.k")).alias("w"))
    return p.join(pixels.select("y", "x"), ["y", "x"], "left_semi").select("y", "x", (F.col("s") / F.col("w")).alias("smooth"))


def b3_smooth(pixels: DataFrame, step: int = 1) -> DataFrame:
    """Normalised B3 convolution, dilated by `step`."""
    return smoothed(pixels, {(i - 2) * step: k / 16 for i, k in enumerate(B3)})


def gauss_smooth(pixels: DataFrame, sigma: float) -> DataFrame:
    """Normalised convolution by a Gaussian, cut at four of its deviations: the mean of what there is, never of zeros put for what is missing."""
    reach = int(4 * sigma + 0.5)
    return smoothed(pixels, {o: math.exp(-o * o / (2 * sigma * sigma)) for o in range(-reach, reach + 1)})


def local_spread(pixels: DataFrame, sigma: float) -> DataFrame:
    """Local standard deviation (y, x, spread) from two normalised convolutions."""
    mean = gauss_smooth(pixels, sigma).withColumnRenamed("smooth", "m")
    square = gauss_smooth(pixels.withColumn("value", F.col("value") * F.col("value")), sigma).withColumnRenamed("smooth", "q")
    return mean.join(square, ["y", "x"]).select("y", "x", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("spread"))


def superpixels(pixels: DataFrame) -> DataFrame:
    """2 x 2 cells of a Bayer mosaic in the order R G / G B as one pixel each; a cell that lacks one of its four sites is void."""
    site = F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))
    at = lambda *k: F.when(F.count("value") == 4, F.avg(F.when(site.isin(*k), F.col("value"))))
    return pixels.groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(at(0).alias("r"), at(1, 2).alias("g"), at(3).alias("b"))


def merge_planes(planes: DataFrame) -> DataFrame:
    """The mosaic (y, x, value) of four planes (plane, y, x, value), plane 2 * oy + ox holding the sites (2y + oy, 2x + ox)."""
    return planes.select((2 * F.col("y") + F.floor(F.col("plane") / 2)).alias("y"), (2 * F.col("x") + F.pmod("plane", F.lit(2))).alias("x"), "value")


def around(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel's value sent to the pixels at `offsets` (dy, dx) from it."""
    o = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    return pixels.select("y", "x", "value", o.alias("o")).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "value")


def green_plane(pixels: DataFrame) -> DataFrame:
    """Green of an R G / G B mosaic at every site: measured, or the mean of four neighbours, null unless all four are there."""
    green = pixels.where(F.pmod(F.col("y") + F.col("x"), F.lit(2)) == 1)
    mean = around(green, [(-1, 0), (1, 0), (0, -1), (0, 1)]).groupBy("y", "x").agg(F.when(F.count("value") == 4, F.avg("value")).alias("mean"))
    own = F.when(F.pmod(F.col("y") + F.col("x"), F.lit(2)) == 1, F.col("value")).otherwise(F.col("mean"))
    return pixels.join(mean, ["y", "x"], "left").select("y", "x", own.alias("green"))


def local_maxima(pixels: DataFrame, above: float) -> DataFrame:
    """Pixels over `above` that none of their eight neighbours exceeds."""
    top = around(pixels, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).groupBy("y", "x").agg(F.max("value").alias("top"))
    return pixels.where(F.col("value") > above).join(top, ["y", "x"]).where("value = top").drop("top")
