"""The stack of exposures against values known beforehand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.operators import stack


def mosaic(scene, oy, ox):
    """Values of an RGGB sensor that looks at scene(y, x) -> (r, g, b)."""
    y, x = np.mgrid[:oy, :ox]
    r, g, b = scene(y, x)
    k = (y % 2) + (x % 2)
    return np.where(k == 0, r, np.where(k == 1, g, b))


def frames_of(spark, rows):
    names = "frame string, exposure_s double, matrix array<double>, moon_x double, moon_y double"
    f = spark.createDataFrame(rows, names)
    return f.withColumns({"black": F.lit(100.0), "white": F.lit(4100.0), "dark": F.lit(100.0), "background": F.lit(0.0), "flux_scale": F.lit(1.0), "transmission": F.lit(1.0), "linearity": F.lit(0.95), "moon_radius": F.lit(5.0), "cirrus": F.lit(0.0)})


def scene(y, x):
    d = np.hypot(y - 19, x - 23)
    base = 40 + 2600 * np.exp(-d / 12)
    return base * 1.1, base, base * 0.8


def exposed(spark, f, shape=(40, 48), shift=None):
    raw = []
    for r in f.collect():
        dy, dx = (shift or {}).get(r.frame, (0, 0))
        a = np.minimum(100 + mosaic(lambda y, x: scene(y - dy, x - dx), *shape) * r.exposure_s, 4100)
        raw += [(r.frame, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(raw, "frame string, y long, x long, raw double")


WHOLE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_stack_covers_the_range_that_no_exposure_covers_alone(spark):
    f = frames_of(spark, [("short", 0.25, WHOLE, 23.0, 19.0), ("mid", 1.0, WHOLE, 23.0, 19.0), ("long", 8.0, [1.0, 0.0, 2.0, 0.0, 1.0, -1.0], 25.0, 18.0)])
    raw = exposed(spark, f, shift={"long": (-1, 2)})  # the long frame's sensor sits elsewhere
    for band in (0.0, 1.5):
        got = {(r.y, r.x): r for r in stack.stacked(stack.resampled(stack.calibrated(raw, f), f, (0, 0, 40, 48), size=16), f, guard=0.5, fade=2.0, band=band, size=16).collect()}
        assert got[19, 23].valid is False and got[19, 23].r is None and got[19, 23].alpha == 0  # behind every moon
        for y, x in ((4, 2), (12, 33), (19, 31), (38, 2)):
            want = scene(np.float64(y), np.float64(x))
            r = got[y, x]
            assert r.valid and r.alpha == 1 and 1 < r.support <= 3.001
            assert [r.r, r.g, r.b] == pytest.approx(want, rel=0.06)  # planes are linear between their pixels
        assert got[4, 2].weight > 9 and got[19, 31].weight < 2  # the bright part is left to short exposures
        assert got[0, 0].coverage < 3 and got[20, 10].coverage == pytest.approx(3)


def test_saturated_hot_and_missing_pixels_never_enter_a_value(spark):
    f = frames_of(spark, [("a", 1.0, WHOLE, -50.0, -50.0)])
    flat = spark.range(24 * 24).select(F.lit("a").alias("frame"), F.floor(F.col("id") / 24).alias("y"), (F.col("id") % 24).alias("x"), F.lit(1100.0).alias("raw"))
    at = lambda y, x: (F.col("y") == y) & (F.col("x") == x)
    raw = flat.withColumn("raw", F.when(at(6, 6), 4099.0).when(at(10, 10), 99_000.0).otherwise(F.col("raw"))).withColumn("flat", F.when(at(14, 14), 0.0).otherwise(1.0)).where(~at(18, 18))
    pixels = stack.calibrated(raw, f).withColumn("hot", at(10, 10))
    got = {(r.y, r.x): r for r in stack.resampled(pixels, f, (0, 0, 24, 24), size=8).collect()}
    assert {round(v, 6) for r in got.values() for v in (r.r, r.g, r.b) if v is not None} == {1000.0}
    assert got[6, 6].support == 0 and got[6, 6].taper == 0 and got[10, 10].support == 0 and got[14, 14].support == 0
    assert (18, 18) not in got  # no sensor there
    assert got[8, 8].support == 1 and got[10, 10].footprint == 1 and got[10, 10].taper == 1
    with pytest.raises(Exception, match="white must exceed black"):
        stack.calibrated(raw, f.withColumn("white", F.lit(50.0))).collect()
    with pytest.raises(Exception, match="must be positive"):
        stack.calibrated(raw, f.withColumn("exposure_s", F.lit(0.0))).collect()


def test_hot_pixels_persist_and_shot_noise_does_not(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:40, :44]
    rows = []
    for k in range(5):
        a = rng.poisson(400 + 5 * x, (40, 44)).astype(float)
        a[12, 20] += 900
        a[30, 8] -= 380
        a[20 + k, 30] += 900  # moves with the sky
        a[5, 5] += 900 if k < 2 else 0
        a[25, 25] = np.nan if k < 3 else a[25, 25] + 900  # too few votes
        rows += [(k, int(i), int(j), None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "frame int, y long, x long, value double")
    assert sorted((r.y, r.x) for r in stack.hot_pixels(df, size=16).collect()) == [(12, 20), (30, 8)]
