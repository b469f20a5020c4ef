"""Rasters as tiles with a halo: stencils in numpy on blocks that Spark deals out, and samples at computed positions.

A raster is a table (*keys, y, x, value); a pixel that has no row, or a null or NaN value, is missing. A tile task gets a dense block
of `size` pixels a side and a halo around it, and answers for the pixels inside; memory is bounded by the tile, whatever the image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: The cubic B-spline kernel, and the parameter of the cubic convolution kernel.
B3 = np.array([1, 4, 6, 4, 1]) / 16
CUBIC = -0.75

TILE = 256


def spread_to_tiles(pixels: DataFrame, keys: tuple[str, ...], value: str, size: int, halo: int, step: int = 1) -> DataFrame:
    """Rows (*keys, ly, lx, ty, tx, y, x, v): each pixel once for each tile whose block or halo holds it.

    With `step` the raster falls into step * step lattices (ly, lx) of every step-th pixel, each tiled by itself.
    """
    d = pixels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("v"))
    for axis in ("y", "x"):
        at = F.floor(F.col(axis) / step)
        d = d.withColumn(f"l{axis}", F.pmod(axis, F.lit(step)))
        d = d.withColumn(f"t{axis}", F.explode(F.sequence(F.floor((at - halo) / size), F.floor((at + halo) / size))))
    return d


def block_of(table: pa.Table, size: int, halo: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dense block with NaN where nothing is, row and column in it of each pixel, whether a pixel lies inside the halo's inner edge)."""
    y, x = table.column("y").to_numpy() // step, table.column("x").to_numpy() // step
    i, j = y - table.column("ty")[0].as_py() * size + halo, x - table.column("tx")[0].as_py() * size + halo
    v = np.full((size + 2 * halo, size + 2 * halo), np.nan)
    v[i, j] = table.column("v").to_numpy(zero_copy_only=False)
    return v, i, j, (i >= halo) & (i < halo + size) & (j >= halo) & (j < halo + size)


def tile_map(pixels: DataFrame, f: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], *, halo: int, out: tuple[str, ...], keys: tuple[str, ...] = (), value: str = "value", size: int = TILE, step: int = 1) -> DataFrame:
    """Rows (*keys, y, x, *out) for every pixel row: what `f` makes of dense blocks (values with NaN, y and x of the first pixel).

    `f` returns arrays of the block's shape, right inside `halo` pixels from its edge; NaN becomes null. `step` tiles each lattice of every
    step-th pixel by itself, so that a kernel dilated by `step` needs the halo of the plain one.
    """

    def run(table: pa.Table) -> pa.Table:
        v, i, j, core = block_of(table, size, halo, step)
        made = f(v, table.column("ty")[0].as_py() * size - halo, table.column("tx")[0].as_py() * size - halo)
        table, i, j = table.filter(pa.array(core)), i[core], j[core]
        found = [pa.array(np.asarray(made[c], dtype=np.float64)[i, j], from_pandas=True) for c in out]
        return pa.table([table.column(c) for c in (*keys, "y", "x")] + found, names=[*keys, "y", "x", *out])

    kinds = [f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in keys]
    d = spread_to_tiles(pixels, keys, value, size, halo, step)
    return d.groupBy(*keys, "ly", "lx", "ty", "tx").applyInArrow(run, ", ".join([*kinds, "y long", "x long", *[f"`{c}` double" for c in out]]))


# Kernels on blocks. What lies beyond a block counts as missing; a missing pixel carries no weight.


def shifted(a: np.ndarray, dy: int, dx: int, fill: float = 0.0) -> np.ndarray:
    """a[y + dy, x + dx], `fill` beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def along(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution by a symmetric kernel along both axes."""
    reach = len(kernel) // 2
    for axis in (0, 1):
        a = sum(k * (shifted(a, o, 0) if axis == 0 else shifted(a, 0, o)) for o, k in zip(range(-reach, reach + 1), kernel))
    return a


def normalised(v: np.ndarray, kernel: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Mean of what there is under the kernel, NaN where there is nothing or less than a share `least` of its weight."""
    there = np.isfinite(v)
    weight = along(there.astype(np.float64), kernel)
    return np.divide(along(np.where(there, v, 0.0), kernel), weight, out=np.full(v.shape, np.nan), where=weight > max(1e-12, least * kernel.sum() ** 2))


def gauss_kernel(sigma: float) -> np.ndarray:
    """A Gaussian cut at four of its deviations."""
    o = np.arange(-gauss_reach(sigma), gauss_reach(sigma) + 1)
    return np.exp(-o * o / (2 * sigma * sigma))


def gauss_reach(sigma: float) -> int:
    return int(4 * sigma + 0.5)


# Stencils.


def gauss(pixels: DataFrame, sigma: float, *, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, smooth): normalised convolution by a Gaussian."""
    return tile_map(pixels, lambda v, *_: {"smooth": normalised(v, gauss_kernel(sigma))}, halo=gauss_reach(sigma), out=("smooth",), keys=keys, size=size)


def local_spread(pixels: DataFrame, sigma: float, *, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, spread): local standard deviation under a Gaussian, of the means of values and of squares."""

    def spread(v: np.ndarray, *_) -> dict[str, np.ndarray]:
        kernel = gauss_kernel(sigma)
        return {"spread": np.sqrt(np.maximum(normalised(v * v, kernel) - normalised(v, kernel) ** 2, 0))}

    return tile_map(pixels, spread, halo=gauss_reach(sigma), out=("spread",), keys=keys, size=size)


def b3(pixels: DataFrame, step: int = 1, *, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, smooth): normalised B3 convolution, dilated by `step`."""
    return tile_map(pixels, lambda v, *_: {"smooth": normalised(v, B3)}, halo=2, out=("smooth",), keys=keys, size=size, step=step)


def bilateral(v: np.ndarray) -> np.ndarray:
    """B3 mean of a block whose weights fall with the distance of a value from the middle one, in units of the local variance."""
    there = np.isfinite(v)
    a = np.where(there, v, 0.0)
    taps = [(dy, dx, float(ky * kx)) for dy, ky in zip(range(-2, 3), B3) for dx, kx in zip(range(-2, 3), B3)]
    mass, first, second = (np.zeros_like(a) for _ in range(3))
    near = [(k * shifted(there.astype(np.float64), dy, dx), shifted(a, dy, dx) - a) for dy, dx, k in taps]
    for w, d in near:
        mass, first, second = mass + w, first + w * d, second + w * d * d
    mass = np.maximum(mass, 1e-20)
    variance = np.maximum(second / mass - (first / mass) ** 2, 1e-20)
    total, norm = np.zeros_like(a), np.zeros_like(a)
    for w, d in near:
        w = w * np.exp(-0.5 * d * d / variance)
        total, norm = total + w * d, norm + w
    return np.where(there, a + total / np.maximum(norm, 1e-20), np.nan)


def b3_bilateral(pixels: DataFrame, step: int = 1, *, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, smooth): bilateral B3 convolution, dilated by `step`."""
    return tile_map(pixels, lambda v, *_: {"smooth": bilateral(v)}, halo=2, out=("smooth",), keys=keys, size=size, step=step)


#: Differences that are less than rounding of single precision makes of two values count as none.
NOISE = 8 * float(np.finfo(np.float32).eps)


def quiet(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(d) <= NOISE * np.maximum(np.abs(a), np.abs(b)), 0.0, d)


def of_keys(d: DataFrame, keys: tuple[str, ...], stats: DataFrame) -> DataFrame:
    """`d` beside the one row that `stats` has for its keys; without keys `stats` is one row in all."""
    return d.join(stats, list(keys)) if keys else d.join(F.broadcast(stats), F.lit(True))


def multiscale_normalised(pixels: DataFrame, sigmas: tuple[float, ...] = (1.25, 2.5, 5, 10, 20, 40), *, k: float = 0.7, h: float = 0.7, gamma: float = 3.2, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, mgn): multi-scale Gaussian normalisation.

    At each sigma the distance from the local mean is taken in local deviations and squeezed by arctan; their mean over the scales and the
    gamma-stretched value between the smallest and largest of all pixels are blended, h for the latter. All scales are made in one
    pass over the tiles. A pixel without a local spread has no detail at that scale, never a made-up one.
    """

    def detail(v: np.ndarray, *_) -> dict[str, np.ndarray]:
        total = np.zeros_like(v)
        for s in sigmas:
            kernel = gauss_kernel(s)
            mean = normalised(v, kernel)
            d = quiet(v - mean, v, mean)
            spread = np.sqrt(np.maximum(normalised(d * d, kernel), 0))
            total += np.arctan(k * np.divide(d, spread, out=np.zeros_like(d), where=spread > 0)) / len(sigmas)
        return {"detail": np.where(np.isfinite(v), total, np.nan), "v": v}

    d = tile_map(pixels, detail, halo=2 * gauss_reach(max(sigmas)), out=("v", "detail"), keys=keys, size=size)
    value = F.when(~F.isnan("value"), F.col("value"))
    ends = pixels.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    stretched = F.when(F.col("hi") > F.col("lo"), F.pow((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(1 / gamma))).otherwise(F.when(F.col("v").isNotNull(), 0.0))
    return of_keys(d, keys, ends).select(*keys, "y", "x", (h * stretched + (1 - h) * F.col("detail")).alias("mgn"))


def whitened(pixels: DataFrame, scales: int, cut: Callable[[DataFrame], DataFrame], *, edges: bool = False, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, wow): wavelets of dilated B3 convolutions, each over its local deviation, and what is left over its own.

    `edges` smooths by the bilateral kernel, so that edges do not ring. A scale is one pass: pixels that a kernel dilated by 2^s joins lie
    on one lattice of every 2^s-th pixel, so lattices are tiled by themselves and the halo stays at four pixels at every scale. `cut`
    materialises each scale, so that no plan grows with their number. Beyond the raster there is nothing, and means are over what there is.
    """

    def scale(v: np.ndarray, *_) -> dict[str, np.ndarray]:
        smooth = bilateral(v) if edges else normalised(v, B3)
        smooth = np.where(np.isfinite(v), smooth, np.nan)
        wave = quiet(v - smooth, v, smooth)
        power = normalised(wave * wave, B3)
        return {"smooth": smooth, "wave": wave / np.sqrt(np.maximum(power, 1e-20))}

    d = cut(pixels.select(*keys, "y", "x", F.when(~F.isnan("value"), F.col("value")).cast("double").alias("value"), F.lit(0.0).alias("sum")))
    for s in range(scales):
        made = tile_map(d, scale, halo=4, out=("smooth", "wave"), keys=keys, size=size, step=1 << s)
        d = cut(d.drop("value").join(made, [*keys, "y", "x"]).select(*keys, "y", "x", F.col("smooth").alias("value"), (F.col("sum") + F.col("wave")).alias("sum")))
    left = d.groupBy(*keys).agg(F.stddev_pop("value").alias("sd"), F.max(F.abs("value")).alias("top"))
    rest = F.when(F.col("sd") > 16 * float(np.finfo(np.float32).eps) * F.col("top"), F.col("value") / F.col("sd")).otherwise(0.0)
    return of_keys(d, keys, left).select(*keys, "y", "x", F.when(F.col("value").isNotNull(), F.col("sum") + rest).alias("wow"))


def relaxed(pixels: DataFrame, rounds: int, cut: Callable[[DataFrame], DataFrame], *, keys: tuple[str, ...] = (), per_pass: int = 32, size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, value) after `rounds` steps in which each pixel that is not `known` becomes the mean of its four neighbours.

    `pixels` has a boolean column `known` and no missing values; a neighbour beyond the raster counts as the pixel itself. A pass makes `per_pass` steps on tiles
    whose halo is as wide, which gives what single steps over the whole raster give, with one shuffle for all.
    """
    code = F.when(F.col("known"), F.lit(1.0)).otherwise(0.0)
    d = pixels.select(*keys, "y", "x", F.col("value").cast("double").alias("value"), code.alias("known"))
    for done in range(0, rounds, per_pass):
        n = min(per_pass, rounds - done)
        d = cut(jacobi(d, n, keys, size))
    return d.select(*keys, "y", "x", "value")


def jacobi(d: DataFrame, n: int, keys: tuple[str, ...], size: int) -> DataFrame:
    """`n` steps of `relaxed` over rows (*keys, y, x, value, known as 0 or 1)."""

    def run(table: pa.Table) -> pa.Table:
        v, i, j, core = block_of(table, size, n)
        known = np.ones(v.shape)
        known[i, j] = table.column("known").to_numpy()
        there = np.isfinite(v)
        free, v = there & (known == 0), np.where(there, v, 0.0)
        around = [(dy, dx, shifted(there.astype(np.float64), dy, dx) > 0) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        for _ in range(n):
            v = np.where(free, sum(np.where(has, shifted(v, dy, dx), v) for dy, dx, has in around) / 4, v)
        table, i, j = table.filter(pa.array(core)), i[core], j[core]
        return pa.table([table.column(c) for c in (*keys, "y", "x")] + [pa.array(v[i, j]), table.column("known")], names=[*keys, "y", "x", "value", "known"])

    kinds = [f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keys]
    t = d.select(*keys, "y", "x", F.col("value").alias("v"), "known")
    for axis in ("y", "x"):
        t = t.withColumn(f"t{axis}", F.explode(F.sequence(F.floor((F.col(axis) - n) / size), F.floor((F.col(axis) + n) / size))))
    return t.groupBy(*keys, "ty", "tx").applyInArrow(run, ", ".join([*kinds, "y long", "x long", "value double", "known double"]))


# Samples.


def cubic_weights(f: np.ndarray) -> np.ndarray:
    """Weights (n, 4) of the pixels at -1, 0, 1, 2 of the cubic convolution kernel, for positions f beyond pixel 0."""
    near = lambda t: (CUBIC + 2) * t**3 - (CUBIC + 3) * t**2 + 1
    far = lambda t: CUBIC * (t**3 - 5 * t**2 + 8 * t - 4)
    return np.stack([far(1 + f), near(f), near(1 - f), far(2 - f)], axis=1)


def weighted(v: np.ndarray, there: np.ndarray, i: np.ndarray, j: np.ndarray, wy: np.ndarray, wx: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of weight times value, sum of weights of what is there) over the pixels from `first` on."""
    total, mass = np.zeros(len(i)), np.zeros(len(i))
    for a in range(wy.shape[1]):
        for b in range(wx.shape[1]):
            w = wy[:, a] * wx[:, b]
            at = (i + first + a, j + first + b)
            total, mass = total + w * v[at], mass + w * there[at]
    return total, mass


def sampled(block: np.ndarray, i: np.ndarray, j: np.ndarray, interp: str) -> np.ndarray:
    """Values of a block at positions (i, j), at least two pixels inside its edge; NaN where a pixel that carries weight is missing.

    Cubic falls back to linear where only the nearest four pixels are there.
    """
    there = np.isfinite(block)
    v, there = np.where(there, block, 0.0), there.astype(np.float64)
    a, b = np.floor(i).astype(np.int64), np.floor(j).astype(np.int64)
    p, q = i - a, j - b
    linear, mass = weighted(v, there, a, b, np.stack([1 - p, p], 1), np.stack([1 - q, q], 1), 0)
    out = np.where(mass >= 0.9999, linear, np.nan)
    if interp == "cubic":
        cubic, full = weighted(v, there, a, b, cubic_weights(p), cubic_weights(q), -1)
        out = np.where((mass >= 0.9999) & (np.abs(full - 1) < 1e-4), cubic, out)
    return out


def gather(raster: DataFrame, positions: DataFrame, *, keys: tuple[str, ...] = (), interp: str = "cubic", size: int = TILE) -> DataFrame:
    """`positions` with `sample`, the raster's value at their columns (py, px) in pixels.

    Tiles with a halo of two pixels meet the positions that fall into them; a position is sent to one tile and a pixel to its own and,
    near an edge, to the next ones. Positions that fall into no tile of the raster get null.
    """
    halo = 3
    tile = lambda c: F.floor(F.col(c) / size)
    d = spread_to_tiles(raster, keys, "value", size, halo).drop("ly", "lx")
    p = positions.withColumns({"ty": tile("py"), "tx": tile("px")})
    columns = positions.columns

    def run(pixels: pa.Table, places: pa.Table) -> pa.Table:
        if not places.num_rows:
            return schema.empty_table()
        found = np.full(places.num_rows, np.nan)
        if pixels.num_rows:
            block, *_ = block_of(pixels, size, halo)
            ty, tx = places.column("ty")[0].as_py(), places.column("tx")[0].as_py()
            found = sampled(block, places.column("py").to_numpy() - ty * size + halo, places.column("px").to_numpy() - tx * size + halo, interp)
        return pa.table([*(places.column(c) for c in columns), pa.array(found, from_pandas=True)], schema=schema)

    schema = to_arrow_schema(positions.schema).append(pa.field("sample", pa.float64()))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.schema), "sample double"])
    on = [*keys, "ty", "tx"]
    return d.groupBy(*on).cogroup(p.groupBy(*on)).applyInArrow(run, kinds)
