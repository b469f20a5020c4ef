"""Named queries over frames of a sensor: calibration, hot pixels and stacks of exposures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stack as S
from ..operators.lineage import cut
from ..operators.raster import gauss_kernel, gauss_reach
from .catalogue import GRID, grid, query, table
from .sky import rounded

#: Fixed: three exposures of a scene on a shifted, slightly turned sensor; (frame, exposure, background, scale, affine map, moon x, moon y).
FRAMES = (
    ("a", 0.5, 3.0, 1.0, (1.0, 0.0, 0.25, 0.0, 1.0, -0.5), 24.0, 12.0),
    ("b", 1.0, 5.0, 1.0, (1.0, 0.01, 0.0, -0.01, 1.0, 0.0), 23.5, 12.5),
    ("c", 2.0, 1.0, 1.05, (1.0, 0.0, -1.4, 0.0, 1.0, 0.7), 22.5, 13.0),
)
BLACK, WHITE, MOON, GUARD, FADE = 512.0, 2712.0, 4.0, 1.0, 3.0


def sensor(spark, sf_dir):
    """(raw pixels, frames, canvas): the grid as exposed by each frame, with a flat that is void in places."""
    g = grid(spark, sf_dir)
    names = "frame string, exposure_s double, background double, flux_scale double, matrix array<double>, moon_x double, moon_y double"
    f = spark.createDataFrame([(*x[:4], list(x[4]), *x[5:]) for x in FRAMES], names)
    f = f.withColumns({"black": F.lit(BLACK), "white": F.lit(WHITE), "dark": F.lit(BLACK + 2), "transmission": F.lit(0.9), "linearity": F.lit(0.95), "moon_radius": F.lit(MOON), "cirrus": F.lit(0.02)})
    each = g.withColumn("frame", F.explode(F.array(*[F.lit(x[0]) for x in FRAMES]))).join(F.broadcast(f.select("frame", "exposure_s")), "frame")
    raw = each.select("frame", "y", "x", (BLACK + F.col("value") * F.col("exposure_s")).alias("raw"), F.when(F.col("value") < 1460, F.lit(0.98)).otherwise(0.0).alias("flat"))
    return raw, f, (-1, -1, int(g.agg(F.max("y")).first()[0]) + 3, 52)


VALUES = ", ".join(f"('{f}', {e}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE, {', '.join(f'{v}::DOUBLE' for v in m)}, {mx}::DOUBLE, {my}::DOUBLE)" for f, e, b, s, m, mx, my in FRAMES)
PREPARED = f"""f(frame, e, sky, scale, m0, m1, m2, m3, m4, m5, mx, my) AS (VALUES {VALUES}), g AS ({GRID}),
raw AS (SELECT frame, y, x, {BLACK} + value * e AS raw, CASE WHEN value < 1460 THEN 0.98 END AS flat, e, sky, scale FROM g, f),
prep AS (SELECT frame, y, x, ((raw - {BLACK + 2}) / flat / e - sky) / (scale * 0.9) AS v, (raw - {BLACK}) / (0.95 * {WHITE - BLACK}) AS q FROM raw)"""


@query(f"""WITH {PREPARED} SELECT frame, y, x, round(v, 6) AS value, round(q, 8) AS ratio FROM prep""")
def sca14_counts_per_second(spark, sf_dir):
    raw, f, _ = sensor(spark, sf_dir)
    return S.calibrated(raw, f).select("frame", "y", "x", F.round("value", 6).alias("value"), F.round("ratio", 8).alias("ratio"))


STEP = "CASE WHEN {0} < {1} THEN 0 WHEN {0} > {2} THEN 1 ELSE (({0} - {1}) / ({2} - {1})) ** 2 * (3 - 2 * ({0} - {1}) / ({2} - {1})) END"
SAMPLED = f"""p AS (SELECT frame, yy.range - 1 AS y, xx.range - 1 AS x, m0 * (xx.range - 1) + m1 * (yy.range - 1) + m2 AS px, m3 * (xx.range - 1) + m4 * (yy.range - 1) + m5 AS py FROM f, range((SELECT max(y) + 3 FROM g)) yy, range(52) xx),
k AS (SELECT p.*, oy.range AS oy, ox.range AS ox, floor((py - oy.range) / 2)::BIGINT AS a, floor((px - ox.range) / 2)::BIGINT AS b, (py - oy.range) / 2 - floor((py - oy.range) / 2) AS fy, (px - ox.range) / 2 - floor((px - ox.range) / 2) AS fx FROM p, range(2) oy, range(2) ox),
t AS (SELECT k.*, 2 * (a + i.range) + oy AS sy, 2 * (b + j.range) + ox AS sx, (CASE i.range WHEN 0 THEN 1 - fy ELSE fy END) * (CASE j.range WHEN 0 THEN 1 - fx ELSE fx END) AS w FROM k, range(2) i, range(2) j),
u AS (SELECT t.frame, t.y, t.x, px, py, oy, ox, coalesce(sum(w * v) FILTER (v IS NOT NULL AND q < 1), 0) AS num, coalesce(sum(w) FILTER (v IS NOT NULL AND q < 1), 0) AS den, coalesce(sum(w) FILTER (z.frame IS NOT NULL), 0) AS foot,
  coalesce(sum(w * greatest(q, 0)) FILTER (v IS NOT NULL), 0) / greatest(coalesce(sum(w) FILTER (v IS NOT NULL), 0), 1e-12) AS top FROM t LEFT JOIN prep z ON z.frame = t.frame AND z.y = sy AND z.x = sx GROUP BY ALL),
c AS (SELECT frame, y, x, px, py, sum(num) FILTER (oy + ox = 0) / nullif(sum(den) FILTER (oy + ox = 0), 0) AS r, sum(num) FILTER (oy + ox = 1) / nullif(sum(den) FILTER (oy + ox = 1), 0) AS g, sum(num) FILTER (oy + ox = 2) / nullif(sum(den) FILTER (oy + ox = 2), 0) AS b,
  least(sum(den) FILTER (oy + ox = 0), sum(den) FILTER (oy + ox = 1) / 2, sum(den) FILTER (oy + ox = 2)) AS support, least(min(foot), 1) AS footprint, greatest(max(top), 0) AS top FROM u GROUP BY ALL),
s AS (SELECT *, 1 - {STEP.format("top", 0.8, 1.0)} AS taper FROM c WHERE footprint > 0)"""


@query(f"""WITH {PREPARED}, {SAMPLED} SELECT frame, y, x, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b, round(support, 8) AS support, round(footprint, 8) AS footprint, round(taper, 7) AS taper FROM s""")
def stn07_resampled_planes(spark, sf_dir):
    raw, f, canvas = sensor(spark, sf_dir)
    d = S.resampled(S.calibrated(raw, f), f, canvas, size=64)
    return d.select("frame", "y", "x", *rounded(5, r=F.col("r"), g=F.col("g"), b=F.col("b")), *rounded(8, support=F.col("support"), footprint=F.col("footprint")), F.round("taper", 7).alias("taper"))


WEIGHED = f"""d AS (SELECT s.*, e, scale, sqrt((px - mx) ** 2 + (py - my) ** 2) - {MOON} AS d FROM s JOIN f USING (frame)),
o AS (SELECT *, d > {GUARD} AND support >= 0.5 AS seen, CASE WHEN d > {GUARD} AND support >= 0.5 THEN support * taper * ({STEP.format("d", GUARD, GUARD + FADE)}) ELSE 0 END AS wt FROM d)"""
ENDS = f"""SELECT y, x, {{linear}}, valid, round(support, 7) AS support, round(coverage, 7) AS coverage, round(weight, 7) AS weight, round(CASE WHEN valid THEN {STEP.format("far", GUARD, GUARD + FADE)} ELSE 0 END, 7) AS alpha FROM m"""
TOTALS = "coalesce(sum(support) FILTER (seen), 0) AS support, sum(footprint) AS coverage, coalesce(max(d) FILTER (footprint >= 0.5), -1e9) AS far"


@query(f"""WITH {PREPARED}, {SAMPLED}, {WEIGHED}, n AS (SELECT y, x, {", ".join(f"sum(wt * e * {c}) FILTER (wt > 0) AS {c}" for c in "rgb")}, sum(wt * e) AS weight, {TOTALS} FROM o GROUP BY 1, 2),
m AS (SELECT *, support >= 0.5 AND weight > 0 AS valid FROM n) {ENDS.format(linear=", ".join(f"round(CASE WHEN valid THEN {c} / weight END, 5) AS {c}" for c in "rgb"))}""")
def agg13_hdr_stack(spark, sf_dir):
    return stack(spark, sf_dir, 0.0)


BAND = 1.5
REACH, WHOLE = gauss_reach(BAND), float(gauss_kernel(BAND).sum() ** 2)
NEAR = f"exp(-((n.x - p.x) ** 2 + (n.y - p.y) ** 2) / (2 * {BAND} * {BAND}))"
CLEAR = "n.seen AND n.taper > 0"


@query(f"""WITH {PREPARED}, {SAMPLED}, {WEIGHED},
l AS (SELECT p.frame, p.y, p.x, {", ".join(f"CASE WHEN sum({NEAR}) FILTER ({CLEAR} AND n.{c} IS NOT NULL) > 0.01 * {WHOLE} THEN sum({NEAR} * n.{c}) FILTER ({CLEAR}) / sum({NEAR}) FILTER ({CLEAR} AND n.{c} IS NOT NULL) END AS l{c}" for c in "rgb")}
  FROM o p JOIN o n ON n.frame = p.frame AND n.x BETWEEN p.x - {REACH} AND p.x + {REACH} AND n.y BETWEEN p.y - {REACH} AND p.y + {REACH} GROUP BY ALL),
w AS (SELECT *, seen AND taper > 0 AND lr IS NOT NULL AND lg IS NOT NULL AND lb IS NOT NULL AS good, greatest((r + 2 * g + b) / 4, 1e-6) AS light, e * scale AS eff FROM o JOIN l USING (frame, y, x)),
v AS (SELECT *, CASE WHEN good THEN wt * e ELSE 0 END AS fw, CASE WHEN good THEN wt / greatest((light / eff + (3.0 / eff) ** 2) / (4 * pi() * {BAND} ** 2) + (0.02 * light) ** 2, 1e-12) ELSE 0 END AS cw FROM w),
n AS (SELECT y, x, {", ".join(f"sum(fw * ({c} - l{c})) FILTER (fw > 0) AS {c}, sum(cw * l{c}) FILTER (cw > 0) AS c{c}" for c in "rgb")}, sum(fw) AS weight, sum(cw) AS cw, {TOTALS} FROM v GROUP BY 1, 2),
m AS (SELECT *, support >= 0.5 AND weight > 0 AND cw > 0 AS valid FROM n) {ENDS.format(linear=", ".join(f"round(CASE WHEN valid THEN {c} / weight + c{c} / cw END, 5) AS {c}" for c in "rgb"))}""")
def agg13_two_bands(spark, sf_dir):
    return stack(spark, sf_dir, BAND)


def stack(spark, sf_dir, band):
    raw, f, canvas = sensor(spark, sf_dir)
    samples = cut(S.resampled(S.calibrated(raw, f), f, canvas, size=64))
    d = S.stacked(samples, f, guard=GUARD, fade=FADE, band=band, size=64)
    return d.select("y", "x", *rounded(5, r=F.col("r"), g=F.col("g"), b=F.col("b")), "valid", *rounded(7, **{c: F.col(c) for c in ("support", "coverage", "weight", "alpha")}))


PLANES = "SELECT l_linenumber AS frame, l_partkey // 50 AS y, l_partkey % 50 AS x, max(l_quantity) AS v FROM lineitem GROUP BY ALL"


@query(f"""WITH p AS (SELECT frame, y, x, v::DOUBLE AS v FROM ({PLANES})), o AS (SELECT i.range - 1 AS i, j.range - 1 AS j FROM range(3) i, range(3) j), r AS (SELECT i.range - 2 AS i, j.range - 2 AS j FROM range(5) i, range(5) j),
wide AS (SELECT DISTINCT frame, y + i AS y, x + j AS x FROM p, r),
m AS (SELECT w.frame, w.y, w.x, any_value(coalesce(s.v, 0)) AS own, median(coalesce(n.v, 0)) AS mid FROM wide w CROSS JOIN o LEFT JOIN p n ON n.frame = w.frame AND n.y = w.y + i AND n.x = w.x + j LEFT JOIN p s ON s.frame = w.frame AND s.y = w.y AND s.x = w.x GROUP BY ALL),
e AS (SELECT p.frame, p.y, p.x, median(abs(m.own - m.mid)) AS mad, count(q.v) AS there FROM p CROSS JOIN r JOIN m ON m.frame = p.frame AND m.y = p.y + i AND m.x = p.x + j LEFT JOIN p q ON q.frame = p.frame AND q.y = p.y + i AND q.x = p.x + j GROUP BY ALL),
z AS (SELECT e.y, e.x, CASE WHEN there = 25 THEN (own - mid) / greatest(1.4826 * mad, sqrt(greatest(mid, 0) + 1), 1e-6) END AS z FROM e JOIN m USING (frame, y, x))
SELECT y, x FROM z GROUP BY 1, 2 HAVING count(z) >= 3 AND greatest(count(*) FILTER (z > 0.3), count(*) FILTER (z < -0.3)) >= 0.8 * count(z)""")
def fil04_hot_pixels(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), F.floor(F.col("l_partkey") / 50).alias("y"), F.pmod("l_partkey", F.lit(50)).alias("x")).agg(F.max("l_quantity").alias("value"))
    return S.hot_pixels(d, threshold=0.3, read_noise=1.0, size=64)
