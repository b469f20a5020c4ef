"""Raster, selection, fit and bootstrap operators against brute force and values known beforehand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.operators import blobs, fits, grid, polar, pyramid, quantiles, raster, resample, select
from annulus.operators.lineage import cut


def pixels(spark, a, **more):
    """A raster from an array; NaN is a null."""
    rows = [(y, x, None if math.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "y long, x long, value double")


def array(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


def scene(h, w, seed=0, holes=True):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    a = 50 + 0.7 * x - 0.3 * y + 9 * np.sin(x / 3) * np.cos(y / 4) + rng.normal(0, 1, (h, w))
    if holes:
        a[rng.random((h, w)) < 0.06] = np.nan
        a[5:9, 11:17] = np.nan
    return a


@pytest.mark.parametrize("size", [7, 16, 256])
def test_tiles_give_what_the_exploded_form_gives(spark, size):
    p = pixels(spark, scene(23, 31))
    for tiled, exploded in ((raster.gauss(p, 1.6, size=size), grid.gauss_smooth(p, 1.6)), (raster.b3(p, 4, size=size), grid.b3_smooth(p, 4))):
        got, want = array(tiled, (23, 31), "smooth"), array(exploded, (23, 31), "smooth")
        assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_images_of_a_key_do_not_mix(spark):
    a, b = scene(9, 12, 1), scene(9, 12, 2)
    two = pixels(spark, a).withColumn("frame", F.lit("a")).union(pixels(spark, b).withColumn("frame", F.lit("b")))
    got = raster.gauss(two, 1.0, keys=("frame",), size=5)
    for name, x in (("a", a), ("b", b)):
        assert np.allclose(array(got.where(F.col("frame") == name), (9, 12), "smooth"), array(raster.gauss(pixels(spark, x), 1.0), (9, 12), "smooth"), equal_nan=True)
    wow = raster.whitened(two, 2, cut, keys=("frame",), size=6)
    assert np.allclose(array(wow.where("frame = 'a'"), (9, 12), "wow"), array(raster.whitened(pixels(spark, a), 2, cut), (9, 12), "wow"), equal_nan=True)


def test_bilateral_keeps_an_edge_and_plain_smoothing_does_not(spark):
    a = np.where(np.arange(24)[None, :] < 12, 10.0, 500.0) + scene(12, 24, 3, False) * 0.001
    p = pixels(spark, a)
    sharp, soft = array(raster.b3_bilateral(p, size=10), (12, 24), "smooth"), array(raster.b3(p, size=10), (12, 24), "smooth")
    assert abs(sharp[:, 11] - a[:, 11]).max() < 0.6 * abs(soft[:, 11] - a[:, 11]).min()


def test_filters_of_many_scales_make_nothing_of_a_constant(spark):
    p = pixels(spark, np.full((14, 15), 7.0))
    assert {r.mgn for r in raster.multiscale_normalised(p, (1.0, 2.0), size=9).collect()} == {0.0}
    assert {r.wow for r in raster.whitened(p, 3, cut, edges=True, size=9).collect()} == {0.0}
    holed = raster.whitened(pixels(spark, scene(20, 21)), 4, cut, size=8)
    got = array(holed, (20, 21), "wow")
    assert np.array_equal(np.isnan(got), np.isnan(scene(20, 21))) and np.isfinite(got[~np.isnan(got)]).all()


def test_polar_view_and_back(spark):
    y, x = np.mgrid[:61, :63]
    a = 3 + 0.2 * x - 0.1 * y + 0.01 * x * y / 60
    p = pixels(spark, a)
    for radial, mirrored in (("linear", False), ("log", True)):
        how = dict(north=33.0, mirrored=mirrored, radial=radial, size=16)
        view = cut(polar.unrolled(p, (30.3, 29.6), (4.0, 27.0), 47, 180, **how))
        assert view.count() == 47 * 180 and view.where("value is null").count() == 0
        back = array(polar.rolled(view, p, (30.3, 29.6), (4.0, 27.0), 47, 180, **how), a.shape)
        r = np.hypot(x - 30.3, y - 29.6)
        assert np.isfinite(back[(r > 5.5) & (r < 25.5)]).all() and np.isnan(back[(r < 4) | (r > 27)]).all()
        assert np.nanmax(abs(back - a)[(r > 5.5) & (r < 25.5)]) < 0.02  # the stated error: a slowly changing field comes back
    one = array(polar.unrolled(p, (30, 29), (10.0, 11.0), 2, 8, start=-22.5, antialias=False, size=16).select(F.col("ring").alias("y"), F.col("col").alias("x"), "value"), (2, 8))
    assert one[0, 0] == pytest.approx(a[19, 30]) and one[0, 2] == pytest.approx(a[29, 20]) and one[0, 4] == pytest.approx(a[39, 30])  # north, east, south


def test_polar_cells_beside_holes_are_null_and_cubic_falls_back_to_linear(spark):
    a = np.full((40, 40), 5.0)
    a[10, 20] = np.nan
    a[20, 30:] = 6.0
    view = polar.unrolled(pixels(spark, a), (20, 20), (9.0, 11.0), 3, 36, start=-5.0, antialias=False, size=9)
    cells = {(r.ring, r.col): r.value for r in view.collect()}
    assert cells[1, 0] is None  # falls on the hole itself
    assert cells[0, 0] == 5.0 and cells[2, 0] == 5.0  # whole pixels beside it carry all the weight
    edge = polar.unrolled(pixels(spark, a[:, :22]), (20, 20), (1.2, 1.3), 2, 36, start=-5.0, size=9, interp="cubic")
    found = [r.value for r in edge.collect()]
    assert None in found and {round(v, 9) for v in found if v is not None} == {5.0}


def greedy(rows, radius):
    kept = []
    for i, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 > radius * radius for _, a, b, _ in kept):
            kept.append((i, x, y, s))
    return sorted(kept)


@pytest.mark.parametrize("radius", [1.0, 6.0])
def test_suppression_is_that_of_the_loop(spark, radius):
    r = random.Random(4)
    chain = [(1000 + k, k * 0.9 * radius, 500.0, 50.0 - k) for k in range(12)]  # each waits for the one before
    crowd = [(2000 + k, 900 + r.random() * radius / 3, 900 + r.random() * radius / 3, float(r.randrange(3))) for k in range(200)]
    lattice = [(3000 + k, (k % 15) * radius, (k // 15) * radius + 2000, 1.0) for k in range(150)]  # ties, all exactly a radius apart
    rows = [(k, r.uniform(0, 60), r.uniform(0, 60), float(r.randrange(6))) for k in range(400)] + chain + crowd + lattice
    df = spark.createDataFrame([*rows, (9001, None, 1.0, 2.0), (9002, 1.0, 1.0, float("nan"))], "id long, x double, y double, strength double").repartition(5)
    assert sorted(tuple(x) for x in select.suppressed(df, radius).collect()) == greedy(rows, radius)
    assert select.suppressed(df.where("false"), radius).collect() == []


def flooded(mask, eight):
    h, w = mask.shape
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (eight or not (i and j))]
    label = {}
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) not in label:
            todo = [(y, x)]
            label[y, x] = y * w + x
            while todo:
                a, b = todo.pop()
                for i, j in steps:
                    n = (a + i, b + j)
                    if 0 <= n[0] < h and 0 <= n[1] < w and mask[n] and n not in label:
                        label[n] = y * w + x
                        todo.append(n)
    return label


def spiral(n):
    m = np.zeros((n, n), dtype=bool)
    y, x, d, k = 0, 0, 0, 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    m[0, 0] = True
    for length in [n - 1] + [v for s in range(n - 1, 1, -2) for v in (s, s)]:
        for _ in range(length):
            y, x = y + steps[d % 4][0], x + steps[d % 4][1]
            if 0 <= y < n and 0 <= x < n:
                m[y, x] = True
        d += 1
    return m


@pytest.mark.parametrize("eight", [False, True])
def test_regions_are_those_of_a_flood(spark, eight):
    rng = np.random.default_rng(5)
    m = np.zeros((44, 70), dtype=bool)
    m[:29, :29] = spiral(29)
    m[:, 32:] = rng.random((44, 38)) < 0.45
    df = spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(m))], "y long, x long")
    got = {(r.y, r.x): r.label for r in blobs.labelled(df, width=70, eight=eight, size=8).collect()}
    assert got == flooded(m, eight)
    both = df.withColumn("frame", F.lit(1)).union(df.where("x > 40").withColumn("frame", F.lit(2)))
    two = blobs.labelled(both, width=70, eight=eight, keys=("frame",), size=8)
    assert {(r.y, r.x): r.label for r in two.where("frame = 1").collect()} == got
    right = m.copy()
    right[:, :41] = False
    assert {(r.y, r.x): r.label for r in two.where("frame = 2").collect()} == flooded(right, eight)


def test_pyramid_puts_constants_and_ramps_back_on_an_odd_canvas(spark):
    y, x = np.mgrid[:29, :37]
    known = (np.abs(y - 14) > 3) | (np.abs(x - 20) > 5)
    for a, error in ((np.full((29, 37), 4.0), 1e-9), (1.0 + 0.3 * x - 0.2 * y, 0.35)):
        p = pixels(spark, a).withColumn("known", (F.abs(F.col("y") - 14) > 3) | (F.abs(F.col("x") - 20) > 5))
        got = array(pyramid.pulled_and_pushed(p, 29, 37), a.shape)
        assert np.array_equal(got[known], a[known]) and abs(got - a).max() < error
        smooth = array(pyramid.continued(p, 29, 37, rounds=120, per_pass=40), a.shape)
        assert np.array_equal(smooth[known], a[known]) and abs(smooth - a).max() < max(1e-9, 0.2 * error)


def test_relaxation_in_passes_is_that_of_single_steps(spark):
    a = scene(15, 18, 6, False)
    known = np.random.default_rng(7).random(a.shape) < 0.5
    p = spark.createDataFrame([(int(y), int(x), float(v), bool(known[y, x])) for (y, x), v in np.ndenumerate(a)], "y long, x long, value double, known boolean")
    want = a.copy()
    for _ in range(7):
        q = np.pad(want, 1, mode="edge")
        want = np.where(known, want, (q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:]) / 4)
    assert np.allclose(array(raster.relaxed(p, 7, cut, per_pass=3, size=6), a.shape), want, atol=1e-12)


def test_quantiles_are_exact_however_values_lie(spark):
    rng = np.random.default_rng(8)
    groups = {"ties": np.repeat([1.0, 2.0, 2.5], [50, 3, 48]), "wide": np.exp(rng.normal(0, 30, 401)), "one": np.array([3.25]), "near": 1 + rng.random(300) * 1e-13, "signs": rng.normal(0, 1, 1000)}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("ties", None), ("ties", float("nan")), ("none", None), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = (0.0, 0.16, 0.5, 0.84, 1.0)
    got = {(r.k, r.prob): (r.n, r.quantile) for r in quantiles.exact_quantiles(df, ("k",), "v", probs, buckets=64).collect()}
    for k, g in [*groups.items(), (None, np.array([4.0, 6.0]))]:
        for p in probs:
            assert got[k, p] == (len(g), pytest.approx(np.percentile(g, 100 * p), rel=1e-12))
    assert len(got) == 6 * len(probs)
    assert quantiles.exact_median(df.where("k = 'signs'"), (), "v").first()["median"] == pytest.approx(np.median(groups["signs"]), rel=1e-12)


def looped(y, a, clip, floor, rounds, again):
    ok = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        c = np.linalg.lstsq(a[ok], y[ok], rcond=None)[0]
        r = y - a @ c
        mid = np.median(r[ok])
        near = np.abs(r - mid) <= clip * max(1.4826 * np.median(np.abs(r[ok] - mid)), floor)
        new = near if again else ok & near
        if (new == ok).all():
            break
        ok = new
    c = np.linalg.lstsq(a[ok], y[ok], rcond=None)[0]
    s2 = ((y[ok] - a[ok] @ c) ** 2).sum() / (ok.sum() - a.shape[1])
    return ok, c, s2 * np.linalg.inv(a[ok].T @ a[ok])


@pytest.mark.parametrize("again, large, rounds", [(False, False, 6), (True, True, 2)])
def test_robust_fit_gives_coefficients_and_covariance_of_the_loop(spark, again, large, rounds):
    rng = np.random.default_rng(9)
    n = 240
    a = np.stack([np.ones(n), rng.normal(0, 1, n), rng.uniform(-2, 2, n)], 1)
    y = a @ [2.0, -0.5, 0.25] + rng.normal(0, 0.05, n)
    y[::7] += rng.normal(0, 4, len(y[::7]))
    rows = [("k", float(v), *map(float, x)) for v, x in zip(y, a)] + [("k", None, 1.0, 0.0, 0.0), ("flat", 3.0, 1.0, 0.0, 0.0), ("flat", 3.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, v double, one double, p double, q double").repartition(3)
    fit, kept = fits.robust_linear(df, "v", ("one", "p", "q"), keys=("k",), clip=2.5, rounds=rounds, floor=0.02, again=again, large=large)
    fit = {r.k: r for r in fit.collect()}
    ok, c, cov = looped(y, a, 2.5, 0.02, rounds, again)
    assert fit["k"].n == ok.sum() < n - 20 and kept.where("k = 'k' and kept").count() == ok.sum()
    assert np.allclose(fit["k"].coef, c, rtol=1e-8) and np.allclose(np.reshape(fit["k"].covariance, (3, 3)), cov, rtol=1e-6)
    assert fit["flat"].covariance is None and fit["flat"].coef[0] == pytest.approx(3.0)
    assert abs(fit["k"].coef[1] + 0.5) < 5 * math.sqrt(fit["k"].covariance[4])


def test_sky_is_found_under_a_source_and_refused_without_pixels(spark):
    y, x = np.mgrid[:30, :40]
    sky = 10 + 0.2 * (x - 20) / 20 - 0.4 * ((y - 15) / 15) ** 2
    a = sky + np.where(np.hypot(x - 20, y - 15) < 8, 100, 0) + np.random.default_rng(1).normal(0, 0.01, sky.shape)
    a[3, 3] = 900
    p = pixels(spark, a)
    far = F.hypot(F.col("x") - 20, F.col("y") - 15) > 9
    model, fit = fits.sky_surface(p, far, 30, 40, least=100)
    assert abs(array(model, a.shape, "sky") - sky).max() < 0.02 and fit.first().n < (np.hypot(x - 20, y - 15) > 9).sum()
    with pytest.raises(ValueError, match="only 3 pixels"):
        fits.sky_surface(p, (F.col("y") == 0) & (F.col("x") < 3), 30, 40)


def test_block_bootstrap_draws_whole_blocks_and_errs_as_it_should(spark):
    rng = np.random.default_rng(2)
    # Cells of a block share an offset: the error of a median follows the number of blocks, not of cells.
    offset = rng.normal(0, 0.2, 40)
    rows = [("k", c, float(10 + offset[c // 9] + rng.normal(0, 0.01)), 10.0) for c in range(360)] + [("few", 1, 1.0, 1.0), ("k", 400, None, 1.0), ("k", 401, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, cell long, y double, x double")
    w = resample.block_weights(df.where("k = 'k'").withColumn("block", F.floor(F.col("cell") / 9)), 50, keys=("k",)).groupBy("replicate").agg(F.sum("weight").alias("n"), F.count_distinct("block").alias("d")).collect()
    assert {r.n for r in w} == {41} and len(w) == 50 and 20 < np.mean([r.d for r in w]) < 30  # 1 - 1/e of the blocks
    r = resample.paired_ratios(df, block=9, replicates=300, keys=("k",)).collect()
    assert [x.k for x in r] == ["k"] and r[0].n == 360
    known = 1.2533 * 0.2 / math.sqrt(40) / 10
    assert 0.5 * known < r[0].ratio_of_medians_err < 2 * known and r[0].median_of_ratios_p16 < r[0].median_of_ratios < r[0].median_of_ratios_p84
    cells = resample.paired_ratios(df, block=1, replicates=300, keys=("k",)).first()
    assert cells.ratio_of_medians_err < 0.6 * r[0].ratio_of_medians_err


def test_dipole_comes_back_with_its_direction(spark):
    rng = np.random.default_rng(3)
    v = [0.1 + 0.3 * math.cos(math.radians(c - 70)) + rng.normal(0, 0.02) + (3 if c % 50 == 0 else 0) for c in range(360)]
    df = spark.createDataFrame([(c, float(c), v[c]) for c in range(360)] + [(361, 1.0, None)], "cell long, angle double, v double")
    d = resample.dipole(df, zenith=70.0, replicates=60).first()
    assert d.n < d.n_finite == 360 and d.amplitude == pytest.approx(0.3, abs=0.01) and d.direction == pytest.approx(70, abs=1.5)
    assert d.to_zenith == pytest.approx(0.3, abs=5 * d.to_zenith_err) and abs(d.across) < 5 * d.across_err
