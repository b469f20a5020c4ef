"""Statistics within rings, sectors and other keys, and values normalised by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Standard deviations of a normal law per median absolute deviation.
MAD = 1.4826


def present(c: Column) -> Column:
    """The value, null where it is NaN: missing data are null throughout."""
    return F.when(~F.isnan(c), c)


def robust(df: DataFrame, keys: list[str], value: str, *, least: int = 1) -> DataFrame:
    """Rows (*keys, n, mid, mad) of keys with at least `least` values: count, median, median absolute deviation."""
    d = df.select(*keys, present(F.col(value)).alias("v"))
    mid = d.groupBy(*keys).agg(F.count("v").alias("n"), F.median("v").alias("mid")).where(F.col("n") >= least)
    mad = d.join(mid.select(*keys, "mid"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("mid"))).alias("mad"))
    return mid.join(mad, keys)


def normalise(df: DataFrame, keys: list[str], value: str, *, least: int = 30) -> DataFrame:
    """`df` with mid, mad and residual, the value's distance from the key's median in robust deviations.

    Rows of keys below `least` values are left out; a spread of zero gives a null, never a made-up structure.
    """
    stats = robust(df, keys, value, least=least).select(*keys, "mid", "mad")
    v = present(F.col(value))
    return df.join(stats, keys).withColumn("residual", F.when(F.col("mad") > 0, (v - F.col("mid")) / (F.lit(MAD) * F.col("mad"))))


def interpolated(df: DataFrame, profile: DataFrame, radius: str, value: str, *, width: float) -> DataFrame:
    """`df` with `trend`: the profile (ring, value) of rings of `width`, linear between ring centres and constant beyond the ends."""
    at = F.col(radius) / width - 0.5
    d = df.withColumn("lo", F.floor(at)).withColumn("hi", F.col("lo") + 1).withColumn("f", at - F.col("lo"))
    for side in ("lo", "hi"):
        d = d.join(profile.select(F.col("ring").alias(side), F.col(value).alias(f"v_{side}")), side, "left")
    blend = (1 - F.col("f")) * F.col("v_lo") + F.col("f") * F.col("v_hi")
    return d.withColumn("trend", F.coalesce(blend, "v_lo", "v_hi")).drop("lo", "hi", "f", "v_lo", "v_hi")


def running_median(df: DataFrame, keys: list[str], bin: str, value: str, *, bins: int, reach: int) -> DataFrame:
    """Rows (*keys, bin, running): the median of the values at most `reach` bins away on a circle of `bins`. `df` has a row per key and bin."""
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    d = df.select(*keys, bin, F.col(value).alias("v"), offsets.alias("o")).withColumn(bin, F.pmod(F.col(bin) + F.col("o"), F.lit(bins)))
    return d.groupBy(*keys, bin).agg(F.median("v").alias("running"))


def clipped_fit(df: DataFrame, keys: list[str], y: str, x: str, *, clip: float, rounds: int) -> DataFrame:
    """Rows (*keys, n, slope, base) of straight lines through rows whose residual stays within `clip` robust deviations, `rounds` times over.

    Each round starts from a checkpointed slim table, so that the plan of a round holds no other.
    """
    kept = cut(df.select(*keys, y, x))
    for left in range(rounds, -1, -1):
        fit = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"))
        if not left:
            return fit
        res = cut(kept.join(fit.drop("n"), keys).withColumn("res", F.col(y) - F.col("slope") * F.col(x) - F.col("base")).drop("slope", "base"))
        spread = robust(res, keys, "res").select(*keys, "mid", "mad")
        kept = cut(res.join(spread, keys).where(F.abs(F.col("res") - F.col("mid")) <= clip * MAD * F.col("mad")).select(*keys, y, x))
