"""Ranks and series around a centre: quantile tables of ring and sector cells, Fourier series of rings, edges along rays and circles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fits import predicted, solved
from .lineage import cut
from .quantiles import exact_quantiles
from .raster import gather, gauss, of_keys
from .rings import MAD

#: Fixed value: quantiles that describe a cell.
QUANTILES = 257


def rank_between_rings(df: DataFrame, *, width: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """`df` (*keys, id, r, v) with `rank`: the mid-rank of v in its two nearest rings, linear in the radius between their middles.

    A ring holds the values at floor(r / width). The mid-rank is the share of a ring's values below v plus half the share equal to it. A ring
    without values leaves the other's rank. Each row asks its two rings; members and questions of a ring are ranked by one window, so a
    task holds a ring and not the image.
    """
    at = F.col("r") / width - 0.5
    d = df.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumns({"ring": F.floor(F.col("r") / width), "lo": F.greatest(F.floor(at), F.lit(0)), "f": F.least(F.greatest(at - F.greatest(F.floor(at), F.lit(0)), F.lit(0.0)), F.lit(1.0))})
    own = d.select(*keys, "ring", "v", F.lit(1).alias("member"), F.lit(None).cast(d.schema["id"].dataType).alias("id"), F.lit(0.0).alias("weight"))
    ask = d.select(*keys, "v", "id", F.explode(F.array(F.struct(F.col("lo").alias("ring"), (1 - F.col("f")).alias("weight")), F.struct((F.col("lo") + 1).alias("ring"), F.col("f").alias("weight")))).alias("q"))
    rows = own.unionByName(ask.select(*keys, "q.ring", "v", F.lit(0).alias("member"), "id", "q.weight"))
    ring = Window.partitionBy(*keys, "ring")
    upto = F.sum("member").over(ring.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("member").over(Window.partitionBy(*keys, "ring", "v"))
    rows = rows.withColumns({"upto": upto, "same": same, "n": F.sum("member").over(ring)}).where("member = 0 and n > 0")
    rank = F.col("weight") * (2 * F.col("upto") - F.col("same")) / (2 * F.col("n"))
    mean = rows.groupBy(*keys, "id").agg((F.sum(rank) / F.sum("weight")).alias("blend"), F.max_by((2 * F.col("upto") - F.col("same")) / (2 * F.col("n")), "weight").alias("only"), F.sum("weight").alias("w"))
    return df.join(mean.select(*keys, "id", F.when(F.col("w") > 0, F.col("blend")).otherwise(F.col("only")).alias("rank")), [*keys, "id"], "left")


def cell_quantiles(df: DataFrame, *, width: float, sectors: int, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, ring, sector, q): `QUANTILES` evenly spaced quantiles of v in each cell of (r, angle in degrees, v) with at least `least` values."""
    d = df.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*keys, F.floor(F.col("r") / width).alias("ring"), F.pmod(F.floor(F.col("angle") / (360 / sectors)), F.lit(sectors)).alias("sector"), "v")
    probs = F.array(*[F.lit(k / (QUANTILES - 1)) for k in range(QUANTILES)])
    return d.groupBy(*keys, "ring", "sector").agg(F.percentile("v", probs).alias("q"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def inverted(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where values lie in quantile functions (n, QUANTILES) that do not fall: 0 to 1, the middle of a level stretch, half for a constant one."""
    below, upto = (q < v[:, None]).sum(1), (q <= v[:, None]).sum(1)
    rows, top = np.arange(len(v)), q.shape[1] - 1
    a, b = np.clip(below - 1, 0, top), np.clip(below, 0, top)
    step = q[rows, b] - q[rows, a]
    inside = a + np.divide(v - q[rows, a], step, out=np.zeros(len(v)), where=step > 0)
    place = np.where(upto > below, (below + upto - 1) / 2, np.where(below == 0, 0, np.where(below > top, top, inside))) / top
    return np.where(q[:, 0] == q[:, -1], 0.5, place)


def rank_by_quantiles(df: DataFrame, *, width: float, sectors: int, least: int = 12, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, id, rank) of `df` (*keys, id, r, angle, v): where v lies in the quantile function of its place, which is linear in radius and angle.

    The quantile functions of the four nearest cells (ring by sector, angles close in a circle) are blended by the distances to their middles; a blend of functions
    that do not fall does not fall, so it can be inverted. Cells below `least` values count as missing: the row's own cell must be
    there, and missing neighbours leave their weight to the others. A constant function gives one half. Rows that share their four cells meet
    them once, so the quantiles are not copied to every row.
    """
    cells = cut(cell_quantiles(df, width=width, sectors=sectors, least=least, keys=keys))
    ring, sector = F.col("r") / width - 0.5, F.pmod(F.col("angle"), F.lit(360.0)) / (360 / sectors) - 0.5
    d = df.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*keys, "id", F.col("v").cast("double").alias("v"), F.floor(ring).alias("i"), F.pmod(F.floor(sector), F.lit(sectors)).alias("j"), (ring - F.floor(ring)).alias("f"), (sector - F.floor(sector)).alias("g"))
    # A cell is a corner of the four squares between middles that touch it.
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    corners = cells.select("*", corner.alias("c")).select(*keys, (F.col("ring") - F.col("c.a")).alias("i"), F.pmod(F.col("sector") - F.col("c.b"), F.lit(sectors)).alias("j"), "c.a", "c.b", "q")

    def rank(rows: pa.Table, near: pa.Table) -> pa.Table:
        n = rows.num_rows
        found = np.full(n, np.nan)
        if n and near.num_rows:
            v, f, g = (rows.column(c).to_numpy() for c in ("v", "f", "g"))
            blend, mass, own = np.zeros((n, QUANTILES)), np.zeros(n), np.zeros(n, dtype=bool)
            for a, b, q in zip(near.column("a").to_pylist(), near.column("b").to_pylist(), near.column("q").to_pylist()):
                w = (f if a else 1 - f) * (g if b else 1 - g)
                blend, mass = blend + w[:, None] * np.array(q), mass + w
                own |= ((f >= 0.5) == bool(a)) & ((g >= 0.5) == bool(b))
            ok = own & (mass > 0)
            found[ok] = inverted(blend[ok] / mass[ok, None], v[ok])
        return pa.table([*(rows.column(c) for c in (*keys, "id")), pa.array(found, from_pandas=True)], names=[*keys, "id", "rank"])

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, "id")), "rank double"])
    on = [*keys, "i", "j"]
    return d.groupBy(*on).cogroup(corners.groupBy(*on)).applyInArrow(rank, kinds)


def harmonics(order: int) -> dict[str, F.Column]:
    """The columns of a Fourier series of `angle`, in degrees."""
    a = F.radians("angle")
    return {"one": F.lit(1.0)} | {f"{n}{k}": f(k * a) for k in range(1, order + 1) for n, f in (("c", F.cos), ("s", F.sin))}


def fourier_normalised(df: DataFrame, *, order: int = 6, smooth: float = 2.0, least_share: float = 0.99, sectors: int = 36, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, id, fnrgf) of `df` (*keys, id, ring, angle, v): (v - A) / B, with A and B Fourier series of the angle for each ring.

    A is fitted to the values of a ring and B to their distances from A, by harmonic sums that merge before the shuffle; coefficients are smoothed
    over rings by a Gaussian of `smooth` rings, repeated beyond the ends. B is at least the 0.05 quantile of all of its values. Rings
    need max(60, 6 (2 order + 1)) values. Without a ring whose values cover `least_share` of the sectors nothing is whole, and the series would
    be free where there is no data: the query then fails when it runs.
    """
    base = harmonics(order)
    names, n_c = tuple(base), len(base)
    d = cut(df.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*keys, "id", "ring", F.col("v").cast("double").alias("v"), "angle", *[c.alias(k) for k, c in base.items()]))
    covered = F.count_distinct(F.floor(F.pmod(F.col("angle"), F.lit(360.0)) / (360 / sectors))) / sectors
    rings = d.groupBy(*keys, "ring").agg(F.count("*").alias("n"), covered.alias("covered"))
    whole = rings.groupBy(*keys).agg(F.max("covered").alias("most"))
    checked = F.when(F.col("most") >= least_share, True).otherwise(F.raise_error(F.lit("no whole ring around the centre")).cast("boolean"))
    d = d.join(rings.where(F.col("n") >= max(60, 6 * n_c)).select(*keys, "ring"), [*keys, "ring"], "left_semi")
    d = of_keys(d, keys, whole.where(checked).select(*keys))
    mean = cut(solved(d, (*keys, "ring"), "v", names).select(*keys, "ring", "coef"))
    off = d.join(mean, [*keys, "ring"]).withColumn("off", F.abs(F.col("v") - predicted(names))).drop("coef")
    spread = cut(solved(off, (*keys, "ring"), "off", names).select(*keys, "ring", "coef"))
    a, b = (smoothed_over_rings(x, smooth, n_c, keys) for x in (mean, spread))
    fit = d.join(a.withColumnRenamed("coef", "ca"), [*keys, "ring"]).join(b.withColumnRenamed("coef", "cb"), [*keys, "ring"])
    at = lambda c: sum((F.col(c)[k] * F.col(x) for k, x in enumerate(names)), F.lit(0.0))
    fit = cut(fit.select(*keys, "id", "v", at("ca").alias("a"), at("cb").alias("b")).withColumn("size", F.abs("b")))
    floor = exact_quantiles(fit, keys, "size", (0.05,)).select(*keys, F.col("quantile").alias("floor"))
    return of_keys(fit, keys, floor).select(*keys, "id", ((F.col("v") - F.col("a")) / F.greatest("b", "floor", F.lit(1e-12))).alias("fnrgf"))


def smoothed_over_rings(coef: DataFrame, sigma: float, n: int, keys: tuple[str, ...]) -> DataFrame:
    """Coefficient arrays smoothed over the rings of a key in their order, the first and last repeated beyond the ends."""
    if sigma <= 0:
        return coef
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    order = Window.partitionBy(*(keys or [F.lit(0)]))
    d = coef.withColumns({"k": F.row_number().over(order.orderBy("ring")) - 1, "m": F.count("*").over(order)})
    taps = F.explode(F.array(*[F.struct(F.lit(int(o)).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(range(-reach, reach + 1), weights / weights.sum())]))
    sent = d.select(*keys, "ring", "k", "m", taps.alias("t")).withColumn("from", F.least(F.greatest(F.col("k") + F.col("t.o"), F.lit(0)), F.col("m") - 1))
    both = sent.join(d.select(*keys, F.col("k").alias("from"), "coef"), [*keys, "from"])
    return both.groupBy(*keys, "ring").agg(F.array(*[F.sum(F.col("t.w") * F.col("coef")[k]) for k in range(n)]).alias("coef"))


def limb_points(pixels: DataFrame, centre: tuple[float, float], radius: float, *, rays: int = 1440, search: float = 0.06, smooth: float = 1.2, step: float = 0.25, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, ray, x, y): on each ray from `centre` the steepest rise outwards within radius * (1 +- search), to a part of a step.

    The raster is smoothed by a Gaussian first. Rises are central differences of samples a `step` apart; a parabola through the largest and its two
    neighbours places it. Rays whose rise is at an end or beside missing pixels give no row.
    """
    soft = cut(gauss(pixels, smooth, keys=keys).withColumnRenamed("smooth", "value")) if smooth > 0 else pixels
    n = int(math.ceil(2 * search * radius / step))
    images = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).select()
    d = images.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray")).select(*keys, "ray", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    theta, r = F.col("ray") * (2 * math.pi / rays), radius * (1 - search) + F.col("k") * step
    p = d.select(*keys, "ray", "k", (centre[1] - r * F.cos(theta)).alias("py"), (centre[0] + r * F.sin(theta)).alias("px"))
    g = gather(soft, p, keys=keys, interp="linear")
    on = Window.partitionBy(*keys, "ray").orderBy("k")
    g = g.withColumn("rise", (F.lead("sample").over(on) - F.lag("sample").over(on)) / 2)
    g = g.withColumns({"before": F.lag("rise").over(on), "after": F.lead("rise").over(on)})
    top = g.groupBy(*keys, "ray").agg(F.max_by(F.struct("k", "rise", "before", "after"), F.struct("rise", -F.col("k"))).alias("t")).where("t.before is not null and t.after is not null")
    bend = F.col("t.before") - 2 * F.col("t.rise") + F.col("t.after")
    off = F.when(bend == 0, 0.0).otherwise(F.least(F.greatest(0.5 * (F.col("t.before") - F.col("t.after")) / bend, F.lit(-1.0)), F.lit(1.0)))
    at = radius * (1 - search) + (F.col("t.k") + off) * step
    return top.select(*keys, "ray", (centre[0] + at * F.sin(theta)).alias("x"), (centre[1] - at * F.cos(theta)).alias("y"))


def circles(points: DataFrame, *, clip: float = 2.5, rounds: int = 6, floor: float = 0.05, least: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, x, y, r, rms, n_used, n) of circles fitted to the edge points (*keys, x, y) of each key, a few thousand at most.

    Distances from the circle are weighed down as they grow (by the root of one plus their square), and points beyond `clip` robust deviations take no part in
    the next round. Keys with fewer than `least` points give no row.
    """

    def fit(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        names = [*keys, "x", "y", "r", "rms", "n_used", "n"]
        if len(x) < least:
            return pa.table([table.column(c).slice(0, 0) for c in keys] + [pa.array([], pa.float64())] * 4 + [pa.array([], pa.int64())] * 2, names=names)
        use, c = np.ones(len(x), dtype=bool), np.array([x.mean(), y.mean(), np.hypot(x - x.mean(), y - y.mean()).mean()])
        for _ in range(rounds):
            for _ in range(50):
                dx, dy = x[use] - c[0], y[use] - c[1]
                d = np.hypot(dx, dy)
                res, j = d - c[2], np.stack([-dx / d, -dy / d, -np.ones(len(d))], 1)
                w = 1 / np.sqrt(1 + res * res)
                move = np.linalg.lstsq(j * np.sqrt(w)[:, None], -res * np.sqrt(w), rcond=None)[0]
                c = c + move
                if abs(move).max() < 1e-10:
                    break
            res = np.hypot(x - c[0], y - c[1]) - c[2]
            mid = np.median(res[use])
            new = abs(res - mid) <= clip * max(MAD * np.median(abs(res[use] - mid)), floor)
            if (new == use).all():
                break
            use = new
        res = np.hypot(x - c[0], y - c[1]) - c[2]
        values = [*map(float, c), float(np.sqrt((res[use] ** 2).mean()))]
        return pa.table([table.column(k).slice(0, 1) for k in keys] + [pa.array([v]) for v in values] + [pa.array([int(use.sum())]), pa.array([len(x)])], names=names)

    kinds = [f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys]
    return points.groupBy(*(keys or [F.lit(0).alias("all")])).applyInArrow(fit, ", ".join([*kinds, "x double, y double, r double, rms double, n_used long, n long"]))
