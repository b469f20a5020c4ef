"""Continuation of fields into unknown pixels by a pyramid of halved rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .raster import relaxed

#: The smallest side that is halved again, and a weight that counts as nothing.
LEAST_SIDE, NOTHING = 8, 1e-6
#: Weights in sixteenths of the parent at floor(c / 2) - 1, + 0, + 1 for an even and an odd child.
EVEN, ODD = (1, 6, 1), (0, 4, 4)


def parents(d: DataFrame, *, sides: tuple[int, int], values: tuple[str, ...]) -> DataFrame:
    """`values` of (weight) summed for the parents inside `sides` of the children (y, x) of `d`, in two grouped passes, one per axis."""
    for axis, side in zip(("y", "x"), sides):
        taps = lambda w: F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k / 16).alias("k")) for o, k in zip((-1, 0, 1), w) if k])
        d = d.withColumn("t", F.explode(F.when(F.pmod(axis, F.lit(2)) == 0, taps(EVEN)).otherwise(taps(ODD)))).withColumn(axis, F.floor(F.col(axis) / 2) + F.col("t.o"))
        d = d.where(F.col(axis).between(0, side - 1)).groupBy("y", "x").agg(*[F.sum(F.col(c) * F.col("t.k")).alias(c) for c in values])
    return d


def raised(d: DataFrame, canvas: DataFrame) -> DataFrame:
    """Rows (y, x, up) of `canvas` from the parents (y, x, est): the mean of those whose kernel holds the child, weighted by it."""
    d = d.select("y", "x", F.col("est").alias("s"), F.lit(1.0).alias("w"))
    for axis in ("y", "x"):
        # A parent reaches the children 2p - 2 ... 2p + 2.
        taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k / 16).alias("k")) for o, k in zip(range(-2, 3), (1, 4, 6, 4, 1))])
        d = d.withColumn("t", F.explode(taps)).withColumn(axis, F.col(axis) * 2 + F.col("t.o"))
        d = d.groupBy("y", "x").agg(F.sum(F.col("s") * F.col("t.k")).alias("s"), F.sum(F.col("w") * F.col("t.k")).alias("w"))
    return canvas.join(d, ["y", "x"]).withColumn("up", F.col("s") / F.col("w")).drop("s", "w")


def pulled_and_pushed(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Rows (y, x, value) of the whole canvas of `pixels` (y, x, value, known): known values as they are, the others continued smoothly.

    Sums of weight times value and of weight are halved by grouped sums under the kernel 1 4 6 4 1, until a side is below 8. From the top
    down a pixel takes its own level's mean by its weight (at most 1) and the mean of the parents above for the rest; so values next to the
    known ones follow the fine levels and those far away the coarse ones. Beyond the canvas there is nothing. Each level
    is checkpointed; it has a quarter of the pixels of the one below.
    """
    whole = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(F.col("known"), F.col("value").cast("double")).alias("value"))
    levels = [cut(whole.select("y", "x", F.coalesce("value", F.lit(0.0)).alias("num"), F.col("value").isNotNull().cast("double").alias("den")))]
    h, w = height, width
    while min(h, w) >= LEAST_SIDE:
        h, w = (h + 1) // 2, (w + 1) // 2
        levels.append(cut(parents(levels[-1], sides=(h, w), values=("num", "den"))))
    own = F.when(F.col("den") > NOTHING, F.col("num") / F.col("den")).otherwise(0.0)
    est = levels[-1].select("y", "x", own.alias("est"))
    for level in reversed(levels[:-1]):
        weight = F.least(F.col("den"), F.lit(1.0))
        est = cut(raised(est, level).select("y", "x", (weight * own + (1 - weight) * F.col("up")).alias("est")))
    return whole.join(est, ["y", "x"]).select("y", "x", F.coalesce("value", "est").alias("value"))


def continued(pixels: DataFrame, height: int, width: int, *, rounds: int = 200, per_pass: int = 32) -> DataFrame:
    """`pulled_and_pushed`, then `relaxed`, so that the continuation meets the known values without a step."""
    known = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col("known") & F.col("value").isNotNull()).alias("known"))
    return relaxed(pulled_and_pushed(pixels, height, width).join(known, ["y", "x"]), rounds, cut, per_pass=per_pass)
