"""Polar views of rasters and back: rings of a centre by angles, sampled where the support is whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import TILE, gather

#: Fixed value: the widest spacing of samples, in pixels.
SPACING = 0.7


def radius_of(ring: Column, r: tuple[float, float], n: int, radial: str) -> Column:
    """Radius of ring 0 ... n - 1, which may be a fraction."""
    if radial not in ("linear", "log"):
        raise ValueError("radial must be 'linear' or 'log'")
    at = ring / max(n - 1, 1)
    return r[0] + at * (r[1] - r[0]) if radial == "linear" else r[0] * F.pow(F.lit(r[1] / r[0]), at)


def ring_of(radius: Column, r: tuple[float, float], n: int, radial: str) -> Column:
    """The inverse of `radius_of`."""
    at = (radius - r[0]) / (r[1] - r[0]) if radial == "linear" else F.ln(F.greatest(radius, F.lit(1e-9)) / r[0]) / math.log(r[1] / r[0])
    return at * (n - 1)


def sampling(n: int, r: tuple[float, float], radial: str, d_angle: float, most: int) -> tuple[Column, Column]:
    """(samples along the arc, samples along the radius) of a ring: as many as keep them `SPACING` apart, at most `most`."""
    at = lambda k: radius_of(F.least(F.greatest(F.col("ring") + k, F.lit(0)), F.lit(n - 1)), r, n, radial)
    step = (at(1) - at(-1)) / F.greatest(F.least(F.col("ring") + 1, F.lit(n - 1)) - F.greatest(F.col("ring") - 1, F.lit(0)), F.lit(1)) if n > 1 else F.lit(1.0)
    count = lambda width: F.least(F.greatest(F.ceil(width / SPACING), F.lit(1)), F.lit(most)).cast("int")
    return count(radius_of(F.col("ring"), r, n, radial) * math.radians(d_angle)), count(F.abs(step))


def unrolled(pixels: DataFrame, centre: tuple[float, float], r: tuple[float, float], n_r: int, n_pa: int, *, north: float = 0.0, mirrored: bool = False, start: float = 0.0, span: float = 360.0,
             radial: str = "linear", interp: str = "cubic", antialias: bool = True, most: int = 12, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, ring, col, value): the raster (*keys, y, x, value) around `centre` (x, y), `n_r` radii by `n_pa` angles.

    Ring 0 is the smallest radius; radii are spaced evenly or in equal ratios (`radial` linear or log). Columns are centred in
    steps of span / n_pa from `start` on, towards growing position angle (from north over east, or west if `mirrored`). With `antialias` a cell is the mean
    of enough samples across and along the arc to lie no further than 0.7 pixels apart, at most `most` each way. A cell is null unless all
    its samples have their support: every pixel with a weight in the interpolation, cubic (or linear where only the nearest four are there) or linear.

    Samples are rows made from the table of rings, in parallel; each meets the tile it falls into, and cells are means over their samples.
    """
    d_angle = span / n_pa
    images = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).select()
    d = images.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("ring"))
    along, across = sampling(n_r, r, radial, d_angle, most) if antialias else (F.lit(1), F.lit(1))
    d = d.withColumns({"along": along, "across": across})
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_pa - 1))).alias("col")).select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("u")).select("*", F.explode(F.sequence(F.lit(0), F.col("along") - 1)).alias("t"))
    at = lambda k: radius_of(F.least(F.greatest(F.col("ring") + k, F.lit(0)), F.lit(n_r - 1)), r, n_r, radial)
    off = (F.col("u") + 0.5) / F.col("across") - 0.5
    if radial == "log":
        radius = radius_of(F.col("ring") + off, r, n_r, radial)
    else:
        radius = at(0) + off * ((r[1] - r[0]) / max(n_r - 1, 1))
    angle = start + (F.col("col") + 0.5) * d_angle + ((F.col("t") + 0.5) / F.col("along") - 0.5) * d_angle
    turned = F.radians(north - angle) if not mirrored else F.radians(north + angle)
    p = d.select(*keys, "ring", "col", (centre[1] - radius * F.cos(turned)).alias("py"), (centre[0] + radius * F.sin(turned)).alias("px"))
    cells = gather(pixels, p, keys=keys, interp=interp, size=size).groupBy(*keys, "ring", "col")
    return cells.agg(F.when(F.count("sample") == F.count("*"), F.avg("sample")).alias("value"))


def rolled(polar: DataFrame, pixels: DataFrame, centre: tuple[float, float], r: tuple[float, float], n_r: int, n_pa: int, *, north: float = 0.0, mirrored: bool = False, start: float = 0.0, span: float = 360.0,
           radial: str = "linear", interp: str = "cubic", keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, value): a table (*keys, ring, col, value) of `unrolled` mapped back to the positions of `pixels` (*keys, y, x).

    Pixels outside the rings or angles, or beside missing cells, are null; a whole circle closes in angle.
    """
    d_angle = span / n_pa
    cells = polar.select(*keys, F.col("ring").cast("long").alias("y"), F.col("col").cast("long").alias("x"), "value")
    if abs(span - 360) < 1e-9:  # columns beyond either end repeat those of the other
        ends = cells.where((F.col("x") < 4) | (F.col("x") >= n_pa - 4))
        cells = cells.unionByName(ends.withColumn("x", F.when(F.col("x") < 4, F.col("x") + n_pa).otherwise(F.col("x") - n_pa)))
        if n_pa < 8:
            raise ValueError("a whole circle needs at least 8 columns")
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    turned = F.degrees(F.atan2(dx, -dy))
    angle = north - turned if not mirrored else turned - north
    p = pixels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), ring_of(F.sqrt(dx * dx + dy * dy), r, n_r, radial).alias("py"), (F.pmod(angle - start, F.lit(360.0)) / d_angle - 0.5).alias("px"))
    return gather(cells, p, keys=keys, interp=interp, size=size).select(*keys, "y", "x", F.col("sample").alias("value"))
