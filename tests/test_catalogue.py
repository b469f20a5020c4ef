"""Every query against its SQL, and operators against values known beforehand."""

import glob
import os

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from annulus.operators import grid, match
from annulus.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def same(x, y):
    return x == y or (x is None or x != x) and (y is None or y != y) or isinstance(x, float) and y is not None and abs(x - y) <= 1e-5 * max(1, abs(x))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert len(got) == len(want)
    key = lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r]
    assert all(same(a, b) for x, y in zip(sorted(got, key=key), sorted(want, key=key)) for a, b in zip(x, y))


def test_normalise_refuses_to_invent_structure(spark):
    from annulus.operators.rings import normalise

    rows = [(1, 5.0)] * 5 + [(2, float("nan")), (2, 1.0), (2, 2.0), (2, 9.0)] + [(3, 1.0)]
    out = normalise(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", least=3).collect()
    assert {r.k for r in out} == {1, 2}
    assert all(r.residual is None for r in out if r.k == 1)
    assert sorted(round(r.residual, 4) for r in out if r.k == 2 and r.v == r.v) == [-0.6745, 0.0, 4.7214]


def test_smoothing_keeps_a_constant_and_skips_holes(spark):
    from annulus.operators.grid import b3_smooth

    g = spark.createDataFrame([(y, x, None if (y, x) == (2, 2) else 7.0) for y in range(5) for x in range(5)], "y long, x long, value double")
    assert {round(r.smooth, 9) for r in b3_smooth(g).collect()} == {7.0}


def test_apertures_of_all_pixels_against_brute_force(spark):
    import statistics

    from annulus.plans.sky import apertures

    px = [(y * 16 + x, float(x), float(y), float((x * 7 + y * 13 + x * y) % 31)) for y in range(14) for x in range(16) if (x + y) % 11]
    got = {r.star: r for r in apertures(spark.createDataFrame(px, "id long, x double, y double, value double"), radii=4, annulus=(5, 8)).collect()}
    assert len(got) == len(px)
    for i, x, y, _ in px:
        d = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, v) for _, a, b, v in px]
        ring = [v for r, v in d if 5 <= r < 8]
        back = statistics.median(ring) if len(ring) >= 40 else None
        assert (got[i].n, got[i].background) == (len(ring), back)
        for k in range(1, 5):
            want = None if back is None else sum(v - back for r, v in d if r <= k)
            assert got[i][f"f{k}"] == (None if want is None else pytest.approx(want, abs=1e-3))
    assert {r.background is None for r in got.values()} == {True, False}


def test_aperture_fluxes_take_every_pixel(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    df = QUERIES["agg20_aperture_fluxes"](spark, "/root/testdata/sf0.001")
    assert df.count() == part and {f"f{k}" for k in range(1, 21)} < set(df.columns)


def test_aperture_sums_need_no_join_and_count_repeated_pixels(spark, con, tmp_path):
    name = "agg20_apertures"
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan  # a table of all pixels was broadcast
    part = spark.read.parquet(f"{SF}/part.parquet")
    odd = part.where("p_partkey % 7 <> 0").unionByName(part.where("p_partkey between 60 and 70"))
    odd.withColumn("p_retailprice", F.when(F.col("p_partkey") != 31, F.col("p_retailprice"))).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("star", "n", "r1", "r2", "r3").collect())
    sql = ORACLE[name].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.sql(f"select star, n, r1, r2, r3 from ({sql})").fetchall())
    assert len(got) == len(want) and all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def crowds(spark):
    """Two lists of stars, a crowd of 3,000 each in a hundredth of the radius, copies, an empty stretch and rows without a place."""
    import random

    r = random.Random(5)
    rows = lambda n, at, wide: [(at + r.random() * wide, r.random() * wide) for _ in range(n)]
    lists = []
    for n in (40, 60):
        xy = rows(3000, 0.0, 0.03) + rows(n, 0.0, 40.0) + [(9.5, 9.5)] * 9 + [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (500.0 + n, 1.0)]
        lists.append([(i, *p) for i, p in enumerate(xy)])
    return lists, [spark.createDataFrame(x, "id long, x double, y double") for x in lists]


def test_nearest_of_crowds_against_brute_force(spark):
    import numpy as np

    (a, b), frames = crowds(spark)
    xy = [np.array([[np.nan if v is None or abs(v) == float("inf") else v for v in p[1:]] for p in side]) for side in (a, b)]
    d = np.sqrt((xy[0][:, None, 0] - xy[1][None, :, 0]) ** 2 + (xy[0][:, None, 1] - xy[1][None, :, 1]) ** 2)
    d[~(d <= 3)] = np.inf
    want = {(i, int(j), k + 1) for i in range(len(a)) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3]) if d[i, j] < np.inf}
    got = match.nearest(*frames, 3.0, 3)
    assert {(r.a_id, r.b_id, r["rank"]) for r in got.collect()} == want
    ab, ba = np.argmin(d, axis=1), np.argmin(d, axis=0)
    mutual = {(i, int(j)) for i, j in enumerate(ab) if d[i, j] < np.inf and ba[j] == i}
    assert {(r.a_id, r.b_id) for r in match.mutual_nearest(*frames, 3.0).collect()} == mutual
    assert {r.id for r in match.unmatched(*frames, 3.0).collect()} == set(np.nonzero(np.isinf(d).all(axis=1))[0].tolist())
    assert match.radius_join(*frames, 3.0).count() == np.isfinite(d).sum()


def test_nearest_begins_in_narrow_cells_where_rows_crowd(spark):
    _, (a, b) = crowds(spark)
    widths = match.widths(match.placed(b).select(F.col("x").alias("bx"), F.col("y").alias("by")), 3.0)
    assert widths[0] < 0.01 and widths[-1] == 3.0 and widths == sorted(widths)


def test_distances_are_rounded_in_doubles_as_the_sql_does(spark, con):
    r = np.random.default_rng(9)
    values = [0.0, 3.0, 5e-7, 4.9e-7, 1.0000005, 2.0000015, 0.1234565, 2.999999499999, *(r.random(20_000) * 3).tolist(), *(r.integers(0, 3_000_000, 2000) / 1e6 + 5e-7).tolist()]
    got = [x.d for x in spark.createDataFrame([(v,) for v in values], "v double").select(match.rounded(F.col("v"), 6).alias("d")).collect()]
    assert got == con.execute("select list_transform(?::double[], lambda x: round(x, 6))", [values]).fetchall()[0][0]
    plan = QUERIES["joi14_within_radius"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan  # a decimal for each of the pairs


@pytest.mark.parametrize("name", ["agg37_spearman", "joi06_one_to_one"])
def test_parts_grow_with_the_rows(spark, monkeypatch, name):
    from annulus.operators import lineage

    monkeypatch.setattr(lineage, "DEALT", 200)  # some 6,000 line items
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 25


def test_bracketed_medians_are_exact(spark):
    from annulus.operators.quantiles import bracketed_median

    r = np.random.default_rng(8)
    groups = {"a": r.normal(size=30_001).tolist(), "b": r.integers(0, 3, 2000).astype(float).tolist(), "c": [5.0], "d": [1.0, 4.0], "e": [7.0] * 9, "f": [3.0, 1.0, 2.0, 9.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("g", None), ("a", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double").repartition(4).cache()
    for reach in (5e-4, 0.0):  # without a reach the bracket misses the middle of some groups
        got = {x.k: (x.n, x["median"]) for x in bracketed_median(d, ("k",), "v", reach=reach).collect()}
        assert got == {k: (len(vs), pytest.approx(float(np.median(vs)), abs=1e-12)) for k, vs in groups.items()}
    assert bracketed_median(d.where("k = 'f'"), (), "v").collect()[0]["median"] == 2.5
    assert bracketed_median(d.limit(0), ("k",), "v").count() == 0


def test_zero_point_takes_no_median_of_a_group_in_one_task(spark, monkeypatch):
    from annulus.operators import fits

    def refuse(*_):
        raise AssertionError("a median of one group")

    monkeypatch.setattr(fits.F, "median", refuse)
    assert QUERIES["agg26_zero_point"](spark, SF).count() == 3


def test_one_to_one_join_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, b string")
    assert [tuple(r) for r in match.one_to_one(a, b.where("b <> 'q'"), ["k"]).collect()] == [(1, "x", "p")]
    with pytest.raises(Exception, match="keys repeat on side b"):
        match.one_to_one(a, b, ["k"]).collect()


def test_normalised_gauss_keeps_a_constant_beside_holes(spark):
    flat = [(y, x, None if (y, x) == (3, 3) else 7.0) for y in range(8) for x in range(8)]
    pixels = spark.createDataFrame(flat, "y int, x int, value double")
    got = {(r.y, r.x): r.smooth for r in grid.gauss_smooth(pixels, 1.5).collect()}
    assert len(got) == 64 and all(abs(v - 7) < 1e-9 for v in got.values())
    assert all(r.spread < 1e-3 for r in grid.local_spread(pixels, 1.0).collect())


def test_superpixel_without_a_site_is_void(spark):
    cell = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0), (0, 2, 1.0), (0, 3, 2.0), (1, 2, 4.0), (1, 3, 8.0)], "y int, x int, value double")
    got = {r.x: (r.r, r.g, r.b) for r in grid.superpixels(cell).collect()}
    assert got == {0: (None, None, None), 1: (1.0, 3.0, 8.0)}


def test_pixel_columns(spark):
    import math

    from annulus.functions import pixel

    d = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in d.select(pixel.to_unsigned(F.col("v"))).collect()] == [32768, 0, 0, 65535]
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        assert abs(spark.range(1).select(pixel.erf(F.lit(x))).first()[0] - math.erf(x)) < 2e-7


def test_texts_and_curves_of_scalars(spark):
    from annulus.functions import pixel, scalar

    one = spark.range(1)
    mags = spark.createDataFrame([("HIP 7 V= 6,25",), ("V =12,5 x",), ("V=?",), (None,), ("v=6,2",)], "t string")
    assert [r[0] for r in mags.select(scalar.labelled_magnitude(F.col("t"))).collect()] == [6.25, 12.5, None, None, None]
    codes = spark.createDataFrame([(-1.0,), (0.0,), (0.003,), (0.5,), (1.0,), (7.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in codes.select(scalar.srgb_code(F.col("v"), 8)).collect()] == [0, 0, 10, 188, 255, 255, 0, 0]
    taken = spark.createDataFrame([("2026:08:12 20:29:48", "5", 8.0), ("2026:08:12 20:29:48", "", 1.0), ("2026:08:12 20:29:48", None, 0.0)], "t string, f string, e double")
    base = spark.sql("select unix_micros(timestamp '2026-08-12 18:29:48 UTC')").first()[0]
    got = [r[0] for r in taken.select(scalar.mid_exposure(F.col("t"), F.col("f"), F.col("e"), 2.0)).collect()]
    assert [g - base for g in got] == [4_500_000, 500_000, 0]
    for bad in (float("nan"), 1.5, -0.1):
        with pytest.raises(Exception, match="alpha must be finite"):
            one.select(pixel.layer_alpha(F.lit(bad), F.lit(True))).collect()
    frame = ((10.0, 20.0), 5.0, (0.0, -1.0), (-1.0, 0.0))
    x, y = scalar.frame_to_pixel(F.lit(2.0), F.lit(90.0), *frame)
    r, a = scalar.pixel_to_frame(x, y, *frame)
    assert [round(v, 9) for v in one.select(x, y, r, a).first()] == [0.0, 20.0, 2.0, 90.0]
    pa = scalar.position_angle(F.lit(1.0), F.lit(0.0), 20.0, mirrored=True)
    assert [round(v, 9) for v in one.select(pa, scalar.image_angle(pa, 20.0, mirrored=True)).first()] == [70.0, 90.0]
