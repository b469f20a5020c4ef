"""Profiles around a centre, text sources, recipes and numbering against brute force and values known beforehand."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.operators import profiles
from annulus.operators.order import numbered
from annulus.sources import recipes, text


def test_rank_between_rings_against_brute_force(spark):
    r = random.Random(1)
    rows = [(k, r.uniform(0, 6) if k % 9 else r.choice([9.2, 11.5]), float(r.randrange(12))) for k in range(260)] + [(900, 2.0, None), (901, 2.0, float("nan"))]
    got = {x.id: x.rank for x in profiles.rank_between_rings(spark.createDataFrame(rows, "id long, r double, v double"), width=1.5).collect()}
    rings = {}
    for _, d, v in rows[:260]:
        rings.setdefault(int(d // 1.5), []).append(v)
    for k, d, v in rows[:260]:
        lo = max(math.floor(d / 1.5 - 0.5), 0)
        f = min(max(d / 1.5 - 0.5 - lo, 0), 1)
        mid = lambda ring: (sum(x < v for x in ring) + sum(x <= v for x in ring)) / (2 * len(ring))
        found = [(w, mid(rings[i])) for w, i in ((1 - f, lo), (f, lo + 1)) if i in rings]
        assert got[k] == pytest.approx(sum(w * m for w, m in found) / sum(w for w, _ in found))
    assert got[900] is None and got[901] is None and len(got) == 262


def test_ranks_by_quantiles_are_uniform_without_rings_and_half_where_nothing_varies(spark):
    rng = np.random.default_rng(2)
    n = 6000
    r, a = 4 * np.sqrt(rng.random(n)) * 5, rng.uniform(0, 360, n)
    v = (20 + r) * (1 + 0.3 * np.cos(np.radians(a))) * (1 + rng.random(n))  # a trend in radius and angle times a uniform draw
    rows = [(k, float(r[k]), float(a[k]), float(v[k])) for k in range(n)] + [(8000 + k, 50.5, 3.6 * k, 7.0) for k in range(200)] + [(9000, 90.0, 1.0, 1.0)]
    got = {x.id: x.rank for x in profiles.rank_by_quantiles(spark.createDataFrame(rows, "id long, r double, angle double, v double"), width=5.0, sectors=8, least=20).collect()}
    ranks = np.array([got[k] for k in range(n) if r[k] > 5])
    assert abs(ranks.mean() - 0.5) < 0.02 and abs(ranks.std() - 1 / math.sqrt(12)) < 0.02
    assert {got[8000 + k] for k in range(200)} == {0.5} and got[9000] is None  # a lone value borrows no cell
    inner = np.array([got[k] for k in range(n) if 7.5 < r[k] < 12.5])
    assert np.histogram(inner, 5, (0, 1))[0].min() > 0.15 * len(inner)
    same = profiles.inverted(np.array([[0.0, 1.0, 1.0, 1.0, 2.0]] * 5), np.array([-1.0, 0.5, 1.0, 2.0, 3.0]))
    assert same.tolist() == [0.0, 0.125, 0.5, 1.0, 1.0]


def test_fourier_series_of_rings_is_that_of_least_squares(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for ring in range(3):
        a = rng.uniform(0, 360, 400)
        v = 5 + ring + 2 * np.cos(np.radians(2 * a)) + (1 + 0.4 * np.sin(np.radians(a))) * rng.normal(0, 1, 400)
        x = np.stack([np.ones(400), *(f(np.radians(k * a)) for k in range(1, 7) for f in (np.cos, np.sin))], 1)
        fit = x @ np.linalg.lstsq(x, v, rcond=None)[0]
        b = x @ np.linalg.lstsq(x, abs(v - fit), rcond=None)[0]
        for k in range(400):
            rows.append((1000 * ring + k, ring, float(a[k]), float(v[k])))
            want[1000 * ring + k] = (v[k] - fit[k], b[k])
    few = [(9000 + k, 9, float(k), 1.0) for k in range(30)]
    df = spark.createDataFrame(rows + few, "id long, ring long, angle double, v double")
    got = {r.id: r.fnrgf for r in profiles.fourier_normalised(df, order=6, smooth=0.0, sectors=12).collect()}
    floor = np.percentile([abs(b) for _, b in want.values()], 5)
    assert set(got) == set(want) and all(got[k] == pytest.approx(d / max(b, floor), rel=1e-6, abs=1e-9) for k, (d, b) in want.items())
    # Coefficients smoothed over the rings in their order, the ends repeated.
    soft = {r.id: r.fnrgf for r in profiles.fourier_normalised(df, order=2, smooth=1.0, sectors=12).collect()}
    x = {ring: np.stack([np.ones(400), *(f(np.radians(k * np.array([q[2] for q in rows if q[1] == ring]))) for k in (1, 2) for f in (np.cos, np.sin))], 1) for ring in range(3)}
    v = {ring: np.array([q[3] for q in rows if q[1] == ring]) for ring in range(3)}
    ca = [np.linalg.lstsq(x[k], v[k], rcond=None)[0] for k in range(3)]
    cb = [np.linalg.lstsq(x[k], abs(v[k] - x[k] @ ca[k]), rcond=None)[0] for k in range(3)]
    w = np.exp(-(np.arange(-4, 5) ** 2) / 2)
    over = lambda c, k: sum(w[o + 4] * c[min(max(k + o, 0), 2)] for o in range(-4, 5)) / w.sum()
    size = [x[k] @ over(cb, k) for k in range(3)]
    least = np.percentile(abs(np.concatenate(size)), 5)
    for k in range(3):
        z = (v[k] - x[k] @ over(ca, k)) / np.maximum(size[k], least)
        assert np.allclose([soft[1000 * k + n] for n in range(400)], z, rtol=1e-6, atol=1e-9)
    with pytest.raises(Exception, match="no whole ring"):
        profiles.fourier_normalised(df.where("angle < 200"), order=1, sectors=12).collect()


def test_limb_of_a_disc_is_found_within_a_tenth_of_a_pixel(spark):
    y, x = np.mgrid[:90, :95]
    d = np.hypot(x - 46.3, y - 44.6)
    a = 100 / (1 + np.exp(-(d - 30.2) / 0.8)) * np.exp(-np.maximum(d - 30, 0) / 60)
    a[:, 74:79] += 3000 * (np.abs(y[:, 74:79] - 44) < 14)  # a bright prominence off the edge
    rows = [(f, int(i), int(j), float(v)) for f in ("a", "b") for (i, j), v in np.ndenumerate(a if f == "a" else np.roll(a, 3, axis=0))]
    df = spark.createDataFrame(rows, "frame string, y long, x long, value double")
    points = profiles.limb_points(df, (45.5, 45.5), 30.0, rays=240, search=0.2, keys=("frame",))
    found = {r.frame: r for r in profiles.circles(points, keys=("frame",)).collect()}
    for f, dy in (("a", 0), ("b", 3)):
        assert abs(found[f].x - 46.3) < 0.1 and abs(found[f].y - 44.6 - dy) < 0.1 and abs(found[f].r - 30.2) < 0.35 and found[f].n_used < found[f].n


def test_circle_is_found_among_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(4)
    t = rng.uniform(0, 2 * math.pi, 500)
    r = 80 + rng.normal(0, 0.1, 500) + np.where(np.arange(500) % 5 == 0, rng.uniform(1, 12, 500), 0)
    rows = [(0, float(120 + r[k] * math.cos(t[k])), float(90 + r[k] * math.sin(t[k]))) for k in range(500)] + [(1, float(k), 0.0) for k in range(5)]
    c = profiles.circles(spark.createDataFrame(rows, "k int, x double, y double"), keys=("k",)).collect()
    assert [x.k for x in c] == [0]  # five points are too few
    assert abs(c[0].x - 120) < 0.1 and abs(c[0].y - 90) < 0.1 and abs(c[0].r - 80) < 0.1 and c[0].rms < 0.2 and 380 < c[0].n_used < 460


def test_located_header_comments_and_ragged_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#title\nRA and so on\n_RA\tname\tv\nu1\tu2\tu3\n--\t--\t--\n1\ta\t2.5\n#no row\n\n2\tb\n3\tc\t\t4\r\n4\td \tx\n")
    (tmp_path / "b.tsv").write_text("_RA\tname\tv\nskipped\ttoo\t1\n--\t--\t--\n5\te\t7\r\n")
    rows, bad = text.located_table(spark, str(tmp_path), "_RA")
    assert rows.columns == ["_RA", "name", "v"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "a", "2.5"), ("4", "d", "x"), ("5", "e", "7")]
    assert sorted(r.value for r in bad.collect()) == ["2\tb", "3\tc\t\t4"]
    (tmp_path / "c.tsv").write_text("_RA\tother\n")
    with pytest.raises(ValueError, match="different headers"):
        text.located_table(spark, str(tmp_path), "_RA")
    with pytest.raises(ValueError, match="no header"):
        text.located_table(spark, str(tmp_path), "_XY")


def test_fields_at_places_keep_bad_lines_apart_and_the_last_line_of_a_key(spark, tmp_path):
    (tmp_path / "h.txt").write_text("H|7|x|1.5\nH|8|y|\nH|no|z|3\nH|7|later|2.5\n# H|9|c|1\nH\n")
    places = {"hip": (1, "int"), "name": (2, "string"), "v": (3, "double")}
    rows, bad = text.positioned_table(spark, str(tmp_path / "h.txt"), places, sep=r"\|", key="hip")
    assert sorted(tuple(r) for r in rows.collect()) == [(7, "later", 2.5), (8, "y", None)]
    assert sorted(r.value for r in bad.collect()) == ["H", "H|no|z|3"]


def test_geometry_and_strict_keys(spark):
    one = lambda x: spark.createDataFrame([(x,)], "t string")
    g = one('{"shape": [4, 5], "sun_xy": [1.5, 2], "sun_radius_px": 9}').select(recipes.geometry(F.col("t")).alias("g")).first().g
    assert (g.shape, g.sun_xy, g.sun_radius_px, g.moon_xy, g.north_deg, g.mirrored, g.note) == ([4, 5], [1.5, 2.0], 9.0, None, 0.0, False, "")
    for bad, says in (('{"shape": [4, 5], "sun_xy": [1, 2], "sun_radius_px": 9, "zoom": 2, "a": 1}', "unknown geometry keys: a, zoom"), ('{"shape": [4, 5]}', "missing geometry keys: sun_xy, sun_radius_px"), ("[1]", "no geometry object")):
        with pytest.raises(Exception, match=says):
            one(bad).select(recipes.geometry(F.col("t")).alias("g")).collect()
    ok = one('{"frames": [], "note": "x"}').select(recipes.strict(F.col("t"), ("frames", "geometry", "stack", "note"), "recipe").alias("t")).first().t
    assert json.loads(ok) == {"frames": [], "note": "x"}


def test_receipt_lists_inputs_with_digests(spark, tmp_path):
    (tmp_path / "in.bin").write_bytes(b"\x00data")
    made = json.loads(recipes.receipt(spark, "sum", {"raw": str(tmp_path / "in.bin"), "gone": str(tmp_path / "none.bin")}, parameters={"k": 1, "s": [0.5]}, gates={"ok": True}).first().receipt)
    assert made["product"] == "sum" and made["parameters"] == {"k": 1, "s": [0.5]} and made["gates"] == {"ok": True}
    assert made["inputs"]["raw"] == {"path": str(tmp_path / "in.bin"), "bytes": 5, "sha256": hashlib.sha256(b"\x00data").hexdigest()}
    assert "sha256" not in made["inputs"]["gone"]


def test_numbers_follow_a_global_order(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(50)) for k in range(3000)]
    got = numbered(spark.createDataFrame(rows, "k long, v long").repartition(7), F.desc("v"), "k").collect()
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert {x.k: x.place for x in got} == want


def test_shift_is_refined_and_kept_without_matches(spark):
    from annulus.operators.match import refined_shift

    r = random.Random(6)
    stars = [(k, r.uniform(0, 400), r.uniform(0, 400)) for k in range(120)]
    moved = [(k, x + 12.25 + r.gauss(0, 0.05), y - 7.5 + r.gauss(0, 0.05)) for k, x, y in stars[:100]] + [(500 + k, r.uniform(0, 400), r.uniform(0, 400)) for k in range(30)]
    a, b = (spark.createDataFrame(x, "id long, x double, y double") for x in (stars, moved))
    start = lambda dx, dy: spark.createDataFrame([(dx, dy)], "dx double, dy double")
    got = refined_shift(a, b, start(10.5, -6.5), (4.0, 1.8, 0.5)).first()
    assert abs(got.dx - 12.25) < 0.03 and abs(got.dy + 7.5) < 0.03 and 95 <= got.matched <= 105
    lost = refined_shift(a, b.limit(2), start(900.0, 0.0), (3.0,)).first()
    assert (lost.dx, lost.dy, lost.matched) == (900.0, 0.0, 0)


def test_nested_models_are_compared_on_the_same_rows(spark):
    from annulus.operators.fits import compared

    rng = np.random.default_rng(7)
    a = np.stack([np.ones(90), rng.normal(0, 1, 90), rng.normal(0, 1, 90)], 1)
    y = a @ [1.0, 2.0, 0.0] + rng.normal(0, 0.1, 90)
    rows = [("k", float(v), *map(float, x)) for v, x in zip(y, a)] + [("k", 1.0, 1.0, None, 2.0), ("one", 3.0, 1.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k string, v double, one double, p double, q double")
    models = {"constant": ("one",), "line": ("one", "p"), "both": ("one", "p", "q")}
    got = {(r.k, r.model): r for r in compared(df, "v", models, keys=("k",)).collect()}
    for name, n in (("constant", 1), ("line", 2), ("both", 3)):
        c, rss, *_ = np.linalg.lstsq(a[:, :n], y, rcond=None)
        r = got["k", name]
        assert r.n == 90 and np.allclose(r.coef, c) and r.rms == pytest.approx(math.sqrt(rss[0] / (90 - n)), rel=1e-6)
        assert np.allclose(r.errors, np.sqrt(rss[0] / (90 - n) * np.diag(np.linalg.inv(a[:, :n].T @ a[:, :n]))), rtol=1e-6)
    assert got["one", "both"].errors is None and len(got) == 6
