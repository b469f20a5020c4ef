"""Block bootstraps as replicate weights, and errors of statistics from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fits import robust_linear, solved
from .lineage import cut
from .raster import of_keys


def drawn(salt: str, replicate: Column, draw: Column, n: Column) -> Column:
    """Which of n blocks a draw takes: 32 bits of a digest of (salt, replicate, draw), modulo n."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), replicate.cast("string"), draw.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def block_weights(cells: DataFrame, replicates: int, *, keys: tuple[str, ...] = (), salt: str = "7") -> DataFrame:
    """Rows (*keys, replicate, block, weight): how often each replicate draws each block, with replacement, as many draws as blocks.

    Blocks are the different values of `block` among the cells of a key, in order. Draws depend on salt, replicate and number alone, so they are
    the same in every run and on every machine.
    """
    blocks = cells.select(*keys, "block").distinct()
    place = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("block")
    named = blocks.select(*keys, "block", (F.row_number().over(place) - 1).alias("at"))
    n = blocks.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")
    draws = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select(*keys, "n", "replicate", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("draw"))
    weights = draws.select(*keys, "replicate", drawn(salt, F.col("replicate"), F.col("draw"), F.col("n")).cast("int").alias("at")).groupBy(*keys, "replicate", "at").agg(F.count("*").alias("weight"))
    return weights.join(named, [*keys, "at"]).select(*keys, "replicate", "block", "weight")


def replicated(cells: DataFrame, replicates: int, *, keys: tuple[str, ...] = (), salt: str = "7") -> DataFrame:
    """`cells` (*keys, block, ...) once for each time that a replicate draws their block, with `replicate`."""
    w = cut(block_weights(cells, replicates, keys=keys, salt=salt))
    return cells.join(w, [*keys, "block"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("copy", "weight")


def paired_ratios(cells: DataFrame, *, block: int, replicates: int = 200, keys: tuple[str, ...] = (), least: int = 12, salt: str = "7") -> DataFrame:
    """Rows (*keys, n, ratio_of_medians, median_of_ratios, and of each _err, _p16, _p84) of paired cells (*keys, cell, y, x).

    Cells need both values and x > 0; keys with fewer than `least` give no row. Errors are standard deviations and quantiles over
    replicates that draw blocks of `block` neighbouring cells, so that what neighbours share does not make them look independent.
    """
    ok = cells.where("y is not null and x > 0").withColumn("block", F.floor(F.col("cell") / block))
    stats = (F.median("y") / F.median("x")).alias("ratio_of_medians"), F.median(F.col("y") / F.col("x")).alias("median_of_ratios")
    base = ok.groupBy(*keys).agg(F.count("*").alias("n"), *stats).where(F.col("n") >= least)
    each = replicated(ok, replicates, keys=keys, salt=salt).groupBy(*keys, "replicate").agg(*stats)
    error = [e for c in ("ratio_of_medians", "median_of_ratios") for e in (F.stddev_pop(c).alias(f"{c}_err"), F.percentile(c, 0.16).alias(f"{c}_p16"), F.percentile(c, 0.84).alias(f"{c}_p84"))]
    errors = each.groupBy(*keys).agg(*error)
    return of_keys(base, keys, errors)


def dipole(cells: DataFrame, *, zenith: float, block: int = 10, replicates: int = 200, keys: tuple[str, ...] = (), least: int = 30, salt: str = "3") -> DataFrame:
    """Rows (*keys, n, n_finite, to_zenith, to_zenith_err, across, across_err, amplitude, direction): v = c0 + a cos + b sin of cells (*keys, cell, angle, v).

    Four rounds drop cells beyond three robust deviations. The dipole is turned to the angle `zenith` and across it; errors are over
    replicates that draw blocks of cells and fit those that the whole fit kept. Keys with fewer than `least` cells give no row.
    """
    on, names = F.radians("angle"), ("one", "cos", "sin")
    d = cells.where("v is not null").select(*keys, "v", F.lit(1.0).alias("one"), F.cos(on).alias("cos"), F.sin(on).alias("sin"), F.floor(F.col("cell") / block).cast("double").alias("block"))
    enough = d.groupBy(*keys).agg(F.count("*").alias("n_finite")).where(F.col("n_finite") >= least)
    d = d.join(enough.select(*keys), list(keys), "left_semi") if keys else d
    fit, kept = robust_linear(d, "v", names, keys=keys, clip=3.0, rounds=4, again=True, about_median=False, carry=("block",))
    z = math.radians(zenith)
    to, across = lambda c: c[1] * math.cos(z) + c[2] * math.sin(z), lambda c: -c[1] * math.sin(z) + c[2] * math.cos(z)
    # Blocks are drawn among those of all finite cells; cells that the fit dropped then take no part.
    w = cut(block_weights(d, replicates, keys=keys, salt=salt))
    again = kept.where("kept").join(w, [*keys, "block"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    each = solved(again, (*keys, "replicate"), "v", names).select(*keys, to(F.col("coef")).alias("to"), across(F.col("coef")).alias("across"))
    errors = each.groupBy(*keys).agg(F.stddev_pop("to").alias("to_zenith_err"), F.stddev_pop("across").alias("across_err"))
    c = F.col("coef")
    base = fit.select(*keys, "n", to(c).alias("to_zenith"), across(c).alias("across"), F.hypot(c[1], c[2]).alias("amplitude"), F.pmod(F.degrees(F.atan2(c[2], c[1])), F.lit(360.0)).alias("direction"))
    return of_keys(of_keys(base, keys, errors), keys, enough)
