"""Stacks of exposures on one canvas: calibrated to counts a second, resampled by observed colour planes, gated and weighted per frame."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import smoothstep
from .lineage import cut
from .raster import TILE, gauss_kernel, gauss_reach, normalised, shifted, tile_map

CHANNELS = ("r", "g", "b")


def checked(ok: Column, value: Column, says: str) -> Column:
    """The value; where a row is not ok the query fails when it runs."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(says)).cast("double"))


def calibrated(raw: DataFrame, frames: DataFrame) -> DataFrame:
    """`raw` (frame, y, x, raw) with value, in counts a second over scale and transmission, and ratio, the share of the linear range that is used.

    `frames` has a row for each frame: exposure_s, black, white, dark, background, flux_scale, transmission, linearity; `raw` may have a column flat and
    one named background, fields of the sensor. A flat that is null or not positive leaves the pixel without a value. White must
    exceed black, and exposures and scales must be positive.
    """
    d = raw.join(frames.select("frame", "exposure_s", "black", "white", "dark", F.col("background").alias("sky"), "flux_scale", "transmission", "linearity"), "frame")
    flat = F.when(F.col("flat") > 0, F.col("flat")) if "flat" in raw.columns else F.lit(1.0)
    back = F.col("sky") + (F.col("background") if "background" in raw.columns else F.lit(0.0))
    exposure = checked((F.col("exposure_s") > 0) & (F.col("flux_scale") > 0) & (F.col("transmission") > 0), F.col("exposure_s"), "exposure, scale and transmission must be positive")
    value = ((F.col("raw") - F.col("dark")) / flat / exposure - back) / (F.col("flux_scale") * F.col("transmission"))
    span = checked(F.col("white") > F.col("black"), F.col("white") - F.col("black"), "white must exceed black")
    return d.select(*raw.columns, value.alias("value"), ((F.col("raw") - F.col("black")) / (F.col("linearity") * span)).alias("ratio"))


def hot_pixels(planes: DataFrame, *, threshold: float = 6.0, persistence: float = 0.8, read_noise: float = 3.0, gain: float = 1.0, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x): pixels of a sensor plane that stand out with the same sign in a share `persistence` of at least three frames.

    `planes` has (*keys, frame, y, x, value). A pixel's distance from the median of its 3 x 3 is measured in the larger of the robust local spread (median of 5 x 5
    absolute distances) and shot and read noise. It votes where all of its 5 x 5 are there; missing pixels count as zero in medians.
    """

    def score(v: np.ndarray, *_) -> dict[str, np.ndarray]:
        there = np.isfinite(v)
        a = np.where(there, v, 0.0)
        near = lambda x, k: np.stack([shifted(x, dy, dx) for dy in range(-k, k + 1) for dx in range(-k, k + 1)])
        middle = np.median(near(a, 1), axis=0)
        off = a - middle
        spread = np.maximum(1.4826 * np.median(near(np.abs(off), 2), axis=0), np.sqrt(np.maximum(middle, 0) / gain + read_noise**2))
        whole = near(there.astype(np.float64), 2).min(axis=0) > 0
        return {"z": np.where(whole, off / np.maximum(spread, 1e-6), np.nan)}

    z = tile_map(planes, score, halo=4, out=("z",), keys=(*keys, "frame"), size=size)
    n = z.groupBy(*keys, "y", "x").agg(F.count("z").alias("n"), F.count_if(F.col("z") > threshold).alias("up"), F.count_if(F.col("z") < -threshold).alias("down"))
    return n.where((F.col("n") >= 3) & (F.greatest("up", "down") >= persistence * F.col("n"))).select(*keys, "y", "x")


def resampled(pixels: DataFrame, frames: DataFrame, canvas: tuple[int, int, int, int], *, pattern: str = "RGGB", taper_start: float = 0.8, size: int = TILE) -> DataFrame:
    """Rows (frame, y, x, px, py, r, g, b, support, footprint, taper) of the canvas (first y, first x, height, width) where a frame reaches it.

    `pixels` are (frame, y, x, value, ratio) of a mosaic, with `hot` true for pixels that take no part; `frames` gives each an affine map `matrix` (six numbers, rows)
    from the canvas to the frame. Each of the four colour planes is interpolated linearly among its own observed pixels: not missing, not hot, below the
    linear limit. support is the least share of weight that was observed of a colour, footprint that inside the sensor, and taper falls from one to zero as the
    fullest plane nears the limit; it never enters the values. Positions meet the tile of the frame that they fall into.
    """
    y0, x0, h, w = canvas
    places = frames.select("frame", "matrix").select("*", F.explode(F.sequence(F.lit(y0), F.lit(y0 + h - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(x0), F.lit(x0 + w - 1))).alias("x"))
    m = lambda k: F.col("matrix")[k]
    places = places.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (m(0) * F.col("x") + m(1) * F.col("y") + m(2)).alias("px"), (m(3) * F.col("x") + m(4) * F.col("y") + m(5)).alias("py"))
    places = places.withColumns({"ty": F.floor(F.col("py") / size), "tx": F.floor(F.col("px") / size)})
    halo = 4
    hot = F.coalesce(F.col("hot"), F.lit(False)) if "hot" in pixels.columns else F.lit(False)
    d = pixels.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"), F.col("ratio").cast("double").alias("ratio"), hot.alias("hot"))
    for axis in ("y", "x"):
        d = d.withColumn(f"t{axis}", F.explode(F.sequence(F.floor((F.col(axis) - halo) / size), F.floor((F.col(axis) + halo) / size))))
    names = ("frame", "y", "x", "px", "py")
    out = (*CHANNELS, "support", "footprint", "taper")

    def run(table: pa.Table, at: pa.Table) -> pa.Table:
        if not table.num_rows or not at.num_rows:
            return pa.table([*(at.column(c).slice(0, 0) for c in names), *([pa.array([], pa.float64())] * len(out))], names=[*names, *out])
        top, left = (at.column(c)[0].as_py() * size - halo for c in ("ty", "tx"))
        shape = (size + 2 * halo, size + 2 * halo)
        i, j = table.column("y").to_numpy() - top, table.column("x").to_numpy() - left
        value, ratio, sensor, out_of_use = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape), np.zeros(shape, dtype=bool)
        value[i, j], ratio[i, j] = (table.column(c).to_numpy(zero_copy_only=False) for c in ("value", "ratio"))
        sensor[i, j], out_of_use[i, j] = 1.0, table.column("hot").to_numpy(zero_copy_only=False)
        y, x = at.column("py").to_numpy() - top, at.column("px").to_numpy() - left
        total, mass, planes = np.zeros((3, len(y))), np.zeros((3, len(y))), np.zeros(3)
        footprint, fullest = np.ones(len(y)), np.zeros(len(y))
        for oy in (0, 1):
            for ox in (0, 1):
                k = "RGB".index(pattern[2 * oy + ox])
                v, q, s, bad = (a[oy::2, ox::2] for a in (value, ratio, sensor, out_of_use))
                known = np.isfinite(v) & np.isfinite(q) & ~bad
                good = known & (q < 1)
                taken = linear(np.stack([np.where(good, v, 0), good, s, known, np.where(known, np.maximum(q, 0), 0)]), (y - oy) / 2, (x - ox) / 2)
                total[k], mass[k], planes[k] = total[k] + taken[0], mass[k] + taken[1], planes[k] + 1
                footprint = np.minimum(footprint, taken[2])
                fullest = np.maximum(fullest, taken[4] / np.maximum(taken[3], 1e-12))
        t = np.clip((fullest - taper_start) / (1 - taper_start), 0, 1)
        made = [*np.divide(total, mass, out=np.full(total.shape, np.nan), where=mass > 0), (mass / planes[:, None]).min(0), footprint, 1 - t * t * (3 - 2 * t)]
        seen = pa.array(footprint > 0)
        return pa.table([*(at.column(c) for c in names), *(pa.array(a, from_pandas=True) for a in made)], names=[*names, *out]).filter(seen)

    kinds = f"frame {frames.schema['frame'].dataType.simpleString()}, y long, x long, px double, py double, " + ", ".join(f"{c} double" for c in out)
    on = ("frame", "ty", "tx")
    return d.groupBy(*on).cogroup(places.groupBy(*on)).applyInArrow(run, kinds)


def linear(planes: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Planes (k, h, w) at positions by linear interpolation; zero beyond the edge."""
    a, b = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    p, q = y - a, x - b
    padded = np.pad(planes, ((0, 0), (1, 2), (1, 2)))
    out = np.zeros((len(planes), len(y)))
    for i, wy in ((0, 1 - p), (1, p)):
        for j, wx in ((0, 1 - q), (1, q)):
            out += wy * wx * padded[:, np.clip(a + i + 1, 0, padded.shape[1] - 1), np.clip(b + j + 1, 0, padded.shape[2] - 1)]
    return out


def stacked(samples: DataFrame, frames: DataFrame, *, guard: float, fade: float, band: float = 0.0, gain: float = 1.0, noise: float = 3.0, size: int = TILE) -> DataFrame:
    """Rows (y, x, r, g, b, valid, support, coverage, weight, alpha): the frames of `resampled` as one weighted mean.

    `frames` gives exposure_s, moon_x, moon_y, moon_radius and, for bands, flux_scale and cirrus. A sample counts where it lies more than `guard` pixels off the
    moon of its own frame and at least half of its support was observed; neither the ramp of width `fade` at the limb nor the taper decides that. Its
    weight is support, taper and ramp times the exposure. With `band` each frame is parted by a Gaussian of that deviation: fine detail is weighted as
    above and the smooth part by its inverse variance (shot and read noise averaged over the Gaussian, and thin cloud, `cirrus` of the brightness). A pixel is valid
    with a support of one half and a weight; alpha is the ramp at the largest distance from any frame's moon.

    Frames meet in one grouped sum per pixel that merges before the shuffle; smoothing runs on tiles of each frame.
    """
    d = samples.join(frames.select("frame", "exposure_s", "moon_x", "moon_y", "moon_radius", *(["flux_scale", "cirrus"] if band else [])), "frame")
    d = d.withColumn("d", F.hypot(F.col("px") - F.col("moon_x"), F.col("py") - F.col("moon_y")) - F.col("moon_radius"))
    seen = (F.col("d") > guard) & (F.col("support") >= 0.5)
    d = d.withColumns({"observed": seen, "wt": F.when(seen, F.col("support") * F.col("taper") * smoothstep(F.col("d"), guard, guard + fade)).otherwise(0.0)})
    fine = F.col("wt") * F.col("exposure_s")
    low = {c: F.lit(0.0) for c in CHANNELS}
    coarse = F.lit(0.0)
    if band:
        d = cut(d)
        good = F.col("observed") & (F.col("taper") > 0)
        for c in CHANNELS:
            part = d.select("frame", "y", "x", F.when(good, F.col(c)).alias("value"))
            soft = tile_map(part, lambda v, *_: {"soft": normalised(v, gauss_kernel(band), 0.01)}, halo=gauss_reach(band), out=("soft",), keys=("frame",), size=size)
            d = d.join(soft.withColumnRenamed("soft", f"low_{c}"), ["frame", "y", "x"])
        low = {c: F.col(f"low_{c}") for c in CHANNELS}
        good = good & low["r"].isNotNull() & low["g"].isNotNull() & low["b"].isNotNull()
        light = F.greatest((F.col("r") + 2 * F.col("g") + F.col("b")) / 4, F.lit(1e-6))
        eff = F.col("exposure_s") * F.col("flux_scale")
        variance = (light / (gain * eff) + F.pow(noise / eff, F.lit(2.0))) / (4 * math.pi * band**2) + F.pow(F.col("cirrus") * light, F.lit(2.0))
        coarse = F.when(good, F.col("wt") / F.greatest(variance, F.lit(1e-12))).otherwise(0.0)
        fine = F.when(good, fine).otherwise(0.0)
    d = d.withColumns({"fine": fine, "coarse": coarse})
    sums = [F.sum("fine").alias("fine"), F.sum("coarse").alias("coarse"), F.sum(F.when(F.col("observed"), F.col("support")).otherwise(0.0)).alias("support"), F.sum("footprint").alias("coverage"), F.max(F.when(F.col("footprint") >= 0.5, F.col("d"))).alias("far")]
    # A sample without weight may have no value.
    part = lambda w, v: F.sum(F.when(F.col(w) > 0, F.col(w) * v))
    sums += [part("fine", F.col(c) - low[c]).alias(f"f_{c}") for c in CHANNELS] + [part("coarse", low[c]).alias(f"c_{c}") for c in CHANNELS]
    s = d.groupBy("y", "x").agg(*sums)
    valid = (F.col("support") >= 0.5) & (F.col("fine") > 0) & ((F.col("coarse") > 0) if band else F.lit(True))
    mean = lambda c: F.when(valid, F.col(f"f_{c}") / F.col("fine") + (F.col(f"c_{c}") / F.col("coarse") if band else 0.0)).alias(c)
    return s.select("y", "x", *[mean(c) for c in CHANNELS], valid.alias("valid"), "support", "coverage", F.col("fine").alias("weight"), F.when(valid & F.col("far").isNotNull(), smoothstep(F.col("far"), guard, guard + fade)).otherwise(0.0).alias("alpha"))
