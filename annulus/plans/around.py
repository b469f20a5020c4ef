"""Named queries around a centre: ranks between rings, quantile tables of cells, Fourier series of rings, limbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as R
from .catalogue import GRID, grid, query, table
from .estimates import fit3_sql
from .rasters import gauss_sql, sampled
from .sky import rounded

PLACED = f"SELECT y * 50 + x AS id, value AS v, sqrt((x - 24.5) ** 2 + (y - 20.25) ** 2) AS r, (((degrees(atan2(-(x - 24.5), -(y - 20.25))) + 720) % 360) + 360) % 360 AS angle FROM ({GRID})"


def placed(spark, sf_dir):
    """The grid with distances and angles around a centre."""
    dx, dy = F.col("x") - 24.5, F.col("y") - 20.25
    angle = F.pmod(F.degrees(F.atan2(-dx, -dy)) + 720, F.lit(360.0))
    return grid(spark, sf_dir).select((F.col("y") * 50 + F.col("x")).alias("id"), F.col("value").alias("v"), F.sqrt(dx * dx + dy * dy).alias("r"), angle.alias("angle"))


@query(f"""WITH p AS (SELECT *, floor(r / 2) AS ring, greatest(floor(r / 2 - 0.5), 0) AS lo FROM ({PLACED})), q AS (SELECT *, least(greatest(r / 2 - 0.5 - lo, 0), 1) AS f FROM p),
a AS (SELECT q.id, m.ring = q.lo AS first, f, (count(*) FILTER (m.v < q.v) + count(*) FILTER (m.v <= q.v)) / (2.0 * count(*)) AS c FROM q JOIN (SELECT ring, v FROM p) m ON m.ring IN (lo, lo + 1) GROUP BY ALL)
SELECT id, round(CASE WHEN count(*) = 2 THEN sum(CASE WHEN first THEN (1 - f) * c ELSE f * c END) ELSE any_value(c) END, 7) AS rank FROM a GROUP BY 1""")
def win08_rank_between_rings(spark, sf_dir):
    return R.rank_between_rings(placed(spark, sf_dir), width=2.0).select("id", F.round("rank", 7).alias("rank"))


PROBS = ", ".join(f"{k}/256.0::DOUBLE" for k in range(R.QUANTILES))


@query(f"""WITH p AS (SELECT *, floor(r / 6)::BIGINT AS ring, floor(angle / 45)::BIGINT % 8 AS sector FROM ({PLACED})),
c AS (SELECT ring, sector, quantile_cont(v::DOUBLE, [{PROBS}]) AS q FROM p GROUP BY 1, 2 HAVING count(*) >= 12),
w AS (SELECT id, v, r / 6 - 0.5 AS a, angle / 45 - 0.5 AS b FROM p), n AS (SELECT id, v, floor(a)::BIGINT AS i, (floor(b)::BIGINT + 8) % 8 AS j, a - floor(a) AS f, b - floor(b) AS g FROM w),
k AS (SELECT id, v, c.q, (CASE x.range WHEN 1 THEN f ELSE 1 - f END) * (CASE z.range WHEN 1 THEN g ELSE 1 - g END) AS w, (f >= 0.5) = (x.range = 1) AND (g >= 0.5) = (z.range = 1) AS own
  FROM n, range(2) x, range(2) z, c WHERE c.ring = i + x.range AND c.sector = (j + z.range) % 8),
u AS (SELECT id, any_value(v) AS v, bool_or(own) AS own, t, sum(w * e) / sum(w) AS q FROM (SELECT id, v, w, own, unnest(q) AS e, unnest(range(257)) AS t FROM k) GROUP BY id, t),
s AS (SELECT id, any_value(v) AS v, bool_or(own) AS own, count(*) FILTER (q < v) AS below, count(*) FILTER (q <= v) AS upto, max(q) FILTER (q < v) AS qa, min(q) FILTER (q >= v) AS qb, min(q) AS first, max(q) AS final FROM u GROUP BY id)
SELECT p.id, round(CASE WHEN NOT own THEN NULL WHEN first = final THEN 0.5 ELSE CASE WHEN upto > below THEN (below + upto - 1) / 2 WHEN below = 0 THEN 0 WHEN below > 256 THEN 256 ELSE below - 1 + (s.v - qa) / (qb - qa) END / 256 END, 6) AS rank FROM p LEFT JOIN s ON s.id = p.id""")
def doc04_rank_by_quantiles(spark, sf_dir):
    return R.rank_by_quantiles(placed(spark, sf_dir), width=6.0, sectors=8).select("id", F.round("rank", 6).alias("rank"))


TURNS = "SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 10000)::BIGINT AS ring, l_orderkey % 360 AS angle, l_quantity AS v, 1.0::DOUBLE AS one, cos(radians(l_orderkey % 360)) AS c1, sin(radians(l_orderkey % 360)) AS s1 FROM lineitem"
SPREAD = "(SELECT d.*, abs(v - f.c1 - f.c2 * d.c1 - f.c3 * d.s1) AS off FROM d JOIN f USING (ring))"


def over_rings_sql(name: str, source: str) -> str:
    """CTE `name` (ring, a, b, c): coefficients smoothed over the rings in their order by a Gaussian of two rings."""
    return f"""{name} AS (WITH k AS (SELECT *, row_number() OVER (ORDER BY ring) - 1 AS k, count(*) OVER () AS m FROM {source}), t AS (SELECT range - 8 AS o, exp(-((range - 8) ** 2) / 8.0) AS w FROM range(17))
  SELECT p.ring, sum(w * n.c1) / sum(w) AS a, sum(w * n.c2) / sum(w) AS b, sum(w * n.c3) / sum(w) AS c FROM k p, t JOIN k n ON n.k = least(greatest(p.k + o, 0), p.m - 1) GROUP BY 1)"""


@query(f"""WITH d AS (SELECT * FROM ({TURNS}) QUALIFY count(*) OVER (PARTITION BY ring) >= 60), {fit3_sql("f", "d", "ring", ("one", "c1", "s1"), "v")}, {fit3_sql("e", SPREAD, "ring", ("one", "c1", "s1"), "off")},
{over_rings_sql("fa", "f")}, {over_rings_sql("fb", "e")}, z AS (SELECT l_orderkey, l_linenumber, ring, v, fa.a + fa.b * c1 + fa.c * s1 AS a, fb.a + fb.b * c1 + fb.c * s1 AS b FROM d JOIN fa USING (ring) JOIN fb USING (ring)),
q AS (SELECT quantile_cont(abs(b), 0.05) AS floor FROM z)
SELECT l_orderkey, l_linenumber, round((v - a) / greatest(b, floor, 1e-12), 6) AS fnrgf FROM z, q""")
def win06_fourier_rings(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    d = d.select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.floor(F.col("l_extendedprice") / 10000).alias("ring"), F.pmod("l_orderkey", F.lit(360)).alias("angle"), F.col("l_quantity").alias("v"))
    return R.fourier_normalised(d, order=1).select("id.l_orderkey", "id.l_linenumber", F.round("fnrgf", 6).alias("fnrgf"))


def occulted(spark, sf_dir):
    """The grid behind a dark disc."""
    dark = F.hypot(F.col("x") - 24.3, F.col("y") - 19.7) <= 12.4
    return grid(spark, sf_dir).withColumn("value", F.when(dark, 0.05 * F.col("value")).otherwise(F.col("value")))


RAYS, SEARCH, STEP = 360, 0.2, 0.25
FIRST = 12.0 * (1 - SEARCH)


@query(f"""WITH dark AS (SELECT y, x, CASE WHEN sqrt((x - 24.3) ** 2 + (y - 19.7) ** 2) <= 12.4 THEN 0.05 * value ELSE value END AS value FROM ({GRID})), {gauss_sql("soft", "dark", "value", 1.2)}, g AS (SELECT y, x, v AS value FROM soft),
p AS (SELECT a.range AS ray, k.range AS k, 20 - ({FIRST} + k.range * {STEP}) * cos(a.range * 2 * pi() / {RAYS}) AS py, 24 + ({FIRST} + k.range * {STEP}) * sin(a.range * 2 * pi() / {RAYS}) AS px FROM range({RAYS}) a, range(20) k), {sampled("linear", "p", "ray, k")},
d AS (SELECT ray, k, (lead(sample) OVER w - lag(sample) OVER w) / 2 AS rise FROM v WINDOW w AS (PARTITION BY ray ORDER BY k)), e AS (SELECT *, lag(rise) OVER w AS b, lead(rise) OVER w AS a FROM d WINDOW w AS (PARTITION BY ray ORDER BY k)),
t AS (SELECT * FROM e WHERE rise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ray ORDER BY rise DESC, k) = 1),
r AS (SELECT ray, {FIRST} + (k + CASE WHEN b - 2 * rise + a = 0 THEN 0 ELSE least(greatest(0.5 * (b - a) / (b - 2 * rise + a), -1), 1) END) * {STEP} AS far FROM t WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT ray::INTEGER AS ray, round(24 + far * sin(ray * 2 * pi() / {RAYS}), 5) AS x, round(20 - far * cos(ray * 2 * pi() / {RAYS}), 5) AS y FROM r""")
def stn38_limb_points(spark, sf_dir):
    d = R.limb_points(occulted(spark, sf_dir), (24.0, 20.0), 12.0, rays=RAYS, search=SEARCH, step=STEP)
    return d.select("ray", *rounded(5, x=F.col("x"), y=F.col("y")))


@query()
def stn38_limb_circle(spark, sf_dir):
    points = R.limb_points(occulted(spark, sf_dir), (24.0, 20.0), 12.0, rays=RAYS, search=SEARCH, step=STEP)
    return R.circles(points).select("n", "n_used", *rounded(4, x=F.col("x"), y=F.col("y"), r=F.col("r"), rms=F.col("rms")))
