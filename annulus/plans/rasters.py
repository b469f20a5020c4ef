"""Named queries over tiled rasters: polar views, multi-scale filters, continuation, regions and greedy selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs as B
from ..operators import polar as P
from ..operators import pyramid as Y
from ..operators import raster as T
from ..operators import select as L
from ..operators.lineage import cut
from .catalogue import GRID, grid, query, table
from .sky import rounded

# Polar views. Fixed: a centre between pixels, 17 rings of one pixel and 72 angles.

CENTRE, RADII, RINGS, ANGLES, NORTH = (24.5, 20.25), (2.0, 18.0), 17, 72, 10.0
TURNED = f"radians({NORTH} - angle)"
SAMPLES = f"""WITH g AS ({GRID}), rings AS (SELECT range AS ring, {RADII[0]} + range * 1.0 AS r FROM range({RINGS})),
n AS (SELECT ring, r, least(greatest(ceil(r * radians({360 / ANGLES}) / 0.7), 1), 12)::BIGINT AS along, 2 AS across FROM rings),
s AS (SELECT ring, c.range AS col, t.range AS t, u.range AS u, r + ((u.range + 0.5) / across - 0.5) AS r, (c.range + 0.5) * {360 / ANGLES} + ((t.range + 0.5) / along - 0.5) * {360 / ANGLES} AS angle
  FROM n, range({ANGLES}) c, range(12) t, range(2) u WHERE t.range < along),
p AS (SELECT ring, col, t, u, {CENTRE[1]} - r * cos({TURNED}) AS py, {CENTRE[0]} + r * sin({TURNED}) AS px FROM s)"""


def sampled(interp: str, places: str, ids: str) -> str:
    """CTEs v (ids, sample): the table `places` (ids, py, px) sampled on g (y, x, value)."""
    near, far = "(1.25 * t ** 3 - 2.25 * t ** 2 + 1)", "(-0.75 * (t ** 3 - 5 * t ** 2 + 8 * t - 4))"
    w = lambda o, f: f"CASE {o} WHEN -1 THEN {far.replace('t', f'(1 + {f})')} WHEN 0 THEN {near.replace('t', f)} WHEN 1 THEN {near.replace('t', f'(1 - {f})')} ELSE {far.replace('t', f'(2 - {f})')} END"
    return f"""f AS (SELECT {ids}, floor(py)::BIGINT AS a, floor(px)::BIGINT AS b, py - floor(py) AS p, px - floor(px) AS q FROM {places}),
o AS (SELECT i.range - 1 AS i, j.range - 1 AS j FROM range(4) i, range(4) j),
k AS (SELECT {ids}, value, {w("i", "p")} * {w("j", "q")} AS cubic, CASE WHEN i IN (0, 1) AND j IN (0, 1) THEN (CASE i WHEN 0 THEN 1 - p ELSE p END) * (CASE j WHEN 0 THEN 1 - q ELSE q END) ELSE 0 END AS lin
  FROM f CROSS JOIN o LEFT JOIN (SELECT y AS gy, x AS gx, value FROM g) ON gy = a + i AND gx = b + j),
m AS (SELECT {ids}, sum(lin * value) AS lin, coalesce(sum(lin) FILTER (value IS NOT NULL), 0) AS lin_mass, sum(cubic * value) AS cubic, coalesce(sum(cubic) FILTER (value IS NOT NULL), 0) AS cubic_mass FROM k GROUP BY ALL),
v AS (SELECT {ids}, CASE WHEN lin_mass >= 0.9999 THEN {"CASE WHEN abs(cubic_mass - 1) < 1e-4 THEN cubic ELSE lin END" if interp == "cubic" else "lin"} END AS sample FROM m)"""


def polar_sql(interp: str) -> str:
    return f"{SAMPLES}, {sampled(interp, 'p', 'ring, col, t, u')} SELECT ring::INTEGER AS ring, col::INTEGER AS col, round(CASE WHEN count(sample) = count(*) THEN avg(sample) END, 6) AS value FROM v GROUP BY ring, col"


def polar(spark, sf_dir, interp):
    return P.unrolled(grid(spark, sf_dir), CENTRE, RADII, RINGS, ANGLES, north=NORTH, interp=interp)


@query(polar_sql("cubic"))
def stn09_polar(spark, sf_dir):
    return polar(spark, sf_dir, "cubic").select("ring", "col", F.round("value", 6).alias("value"))


@query(polar_sql("linear"))
def stn08_polar_linear(spark, sf_dir):
    return polar(spark, sf_dir, "linear").select("ring", "col", F.round("value", 6).alias("value"))


@query(f"""{SAMPLES}, {sampled("cubic", "p", "ring, col, t, u")}, cells AS (SELECT ring, col, CASE WHEN count(sample) = count(*) THEN avg(sample) END AS value FROM v GROUP BY ring, col),
back AS (SELECT * FROM (WITH g AS (SELECT ring AS y, col + s.range * {ANGLES} - {ANGLES} AS x, value FROM cells, range(3) s WHERE col + s.range * {ANGLES} - {ANGLES} BETWEEN -4 AND {ANGLES + 3}),
  p AS (SELECT y, x, sqrt((x - {CENTRE[0]}) ** 2 + (y - {CENTRE[1]}) ** 2) - {RADII[0]} AS py, ((({NORTH} - degrees(atan2(x - {CENTRE[0]}, -(y - {CENTRE[1]}))) + 720) % 360) / {360 / ANGLES}) - 0.5 AS px FROM ({GRID})),
  {sampled("cubic", "p", "y, x")} SELECT * FROM v))
SELECT y, x, round(sample, 6) AS value FROM back""")
def stn10_polar_back(spark, sf_dir):
    g = grid(spark, sf_dir)
    cells = cut(polar(spark, sf_dir, "cubic"))
    return P.rolled(cells, g, CENTRE, RADII, RINGS, ANGLES, north=NORTH).select("y", "x", F.round("value", 6).alias("value"))


# Many scales.


def gauss_sql(name: str, source: str, value: str, sigma: float) -> str:
    """CTE `name` (y, x, v): normalised convolution of `value` of `source` by a Gaussian."""
    reach = T.gauss_reach(sigma)
    w = f"exp(-((n.x - p.x) ** 2 + (n.y - p.y) ** 2) / (2 * {sigma} * {sigma}))"
    return f"{name} AS (SELECT p.y, p.x, sum(n.{value} * {w}) / sum({w}) AS v FROM {source} p JOIN {source} n ON n.x BETWEEN p.x - {reach} AND p.x + {reach} AND n.y BETWEEN p.y - {reach} AND p.y + {reach} GROUP BY 1, 2)"


SCALES = (1.25, 2.5)
DETAIL = ", ".join(
    f"{gauss_sql(f'm{k}', 'g', 'value', s)}, d{k} AS (SELECT *, d * d AS q FROM (SELECT g.y, g.x, CASE WHEN abs(g.value - m.v) <= {T.NOISE} * greatest(abs(g.value), abs(m.v)) THEN 0 ELSE g.value - m.v END AS d FROM g JOIN m{k} m USING (y, x))), {gauss_sql(f's{k}', f'd{k}', 'q', s)}, z{k} AS (SELECT d.y, d.x, CASE WHEN s.v > 0 THEN atan(0.7 * d.d / sqrt(s.v)) ELSE 0 END / {len(SCALES)} AS z FROM d{k} d JOIN s{k} s USING (y, x))"
    for k, s in enumerate(SCALES)
)


@query(f"""WITH g AS ({GRID}), e AS (SELECT min(value) AS lo, max(value) AS hi FROM g), {DETAIL}
SELECT g.y, g.x, round(0.7 * ((value - lo) / (hi - lo)) ** (1 / 3.2) + 0.3 * ({" + ".join(f"z{k}.z" for k in range(len(SCALES)))}), 6) AS mgn FROM e, g {" ".join(f"JOIN z{k} ON z{k}.y = g.y AND z{k}.x = g.x" for k in range(len(SCALES)))}""")
def stn15_multiscale(spark, sf_dir):
    return T.multiscale_normalised(grid(spark, sf_dir), SCALES, size=64).select("y", "x", F.round("mgn", 6).alias("mgn"))


TAPS = "(VALUES (-2, 0.0625::DOUBLE), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625))"


def bilateral_sql(name: str, source: str, step: int) -> str:
    """CTEs: `name` (y, x, v) is the bilateral B3 mean of v of `source`, dilated by `step`."""
    return f"""{name}n AS (SELECT p.y, p.x, p.v AS c, n.v - p.v AS d, a.k * b.k AS k FROM {source} p, {TAPS} a(o, k), {TAPS} b(o, k), {source} n WHERE n.x = p.x + a.o * {step} AND n.y = p.y + b.o * {step}),
{name}v AS (SELECT y, x, greatest(sum(k * d * d) / sum(k) - (sum(k * d) / sum(k)) ** 2, 1e-20) AS vv FROM {name}n GROUP BY 1, 2),
{name} AS (SELECT n.y, n.x, any_value(c) + sum(k * exp(-0.5 * d * d / vv) * d) / sum(k * exp(-0.5 * d * d / vv)) AS v FROM {name}n n JOIN {name}v USING (y, x) GROUP BY 1, 2)"""


def b3_sql(name: str, source: str, value: str, step: int) -> str:
    return f"{name} AS (SELECT p.y, p.x, sum(n.{value} * a.k * b.k) / sum(a.k * b.k) AS v FROM {source} p, {TAPS} a(o, k), {TAPS} b(o, k), {source} n WHERE n.x = p.x + a.o * {step} AND n.y = p.y + b.o * {step} GROUP BY 1, 2)"


@query(f"""WITH g AS (SELECT y, x, value AS v FROM ({GRID})), {bilateral_sql("s", "g", 2)} SELECT y, x, round(v, 6) AS smooth FROM s""")
def stn18_bilateral(spark, sf_dir):
    return T.b3_bilateral(grid(spark, sf_dir), 2, size=64).select("y", "x", F.round("smooth", 6).alias("smooth"))


def whitened_sql(scales: int, edges: bool) -> str:
    """Wavelets over their local deviations, and the rest over its own."""
    parts, sums = [f"c0 AS (SELECT y, x, value AS v FROM ({GRID}))"], []
    for s in range(scales):
        parts.append(bilateral_sql(f"c{s + 1}", f"c{s}", 1 << s) if edges else b3_sql(f"c{s + 1}", f"c{s}", "v", 1 << s))
        parts.append(f"w{s} AS (SELECT a.y, a.x, CASE WHEN abs(a.v - b.v) <= {T.NOISE} * greatest(abs(a.v), abs(b.v)) THEN 0 ELSE a.v - b.v END AS w FROM c{s} a JOIN c{s + 1} b USING (y, x)), q{s} AS (SELECT y, x, w * w AS v FROM w{s})")
        parts.append(b3_sql(f"p{s}", f"q{s}", "v", 1 << s))
        sums.append(f"(SELECT y, x, w / sqrt(greatest(p{s}.v, 1e-20)) AS z FROM w{s} JOIN p{s} USING (y, x))")
    last = f"c{scales}"
    rest = f"(SELECT y, x, CASE WHEN sd > {16 * 2.0**-23} * top THEN v / sd ELSE 0 END AS z FROM {last}, (SELECT stddev_pop(v) AS sd, max(abs(v)) AS top FROM {last}))"
    return f"WITH {', '.join(parts)} SELECT y, x, round(sum(z), 5) AS wow FROM ({' UNION ALL '.join([*sums, rest])}) GROUP BY 1, 2"


@query(whitened_sql(3, False))
def stn19_whitened(spark, sf_dir):
    return T.whitened(grid(spark, sf_dir), 3, cut, size=64).select("y", "x", F.round("wow", 5).alias("wow"))


@query(whitened_sql(3, True))
def stn19_whitened_edges(spark, sf_dir):
    return T.whitened(grid(spark, sf_dir), 3, cut, edges=True, size=64).select("y", "x", F.round("wow", 5).alias("wow"))


# Continuation. Pixels of large parts are unknown.

HOLES = f"SELECT y, x, value, NOT (abs(x - 24) + abs(y - 20) <= 9 OR value > 1480) AS known FROM ({GRID})"


def holes(spark, sf_dir):
    """The grid with unknown pixels, its height and its width."""
    g = grid(spark, sf_dir).withColumn("known", ~((F.abs(F.col("x") - 24) + F.abs(F.col("y") - 20) <= 9) | (F.col("value") > 1480)))
    return cut(g), int(g.agg(F.max("y")).first()[0]) + 1, 50


def pyramid_sql(levels: int = 12) -> str:
    """Levels of a pyramid, down while both sides hold 8 pixels, and back; as many as the canvas needs carry rows."""
    k = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) {}(o, k)"
    parts = [f"g AS ({HOLES}), h0 AS (SELECT max(y) + 1 AS h, 50 AS w FROM g), l0 AS (SELECT y, x, CASE WHEN known THEN value ELSE 0 END AS num, known::INT::DOUBLE AS den FROM g)"]
    for n in range(levels):
        parts.append(f"h{n + 1} AS (SELECT (h + 1) // 2 AS h, (w + 1) // 2 AS w FROM h{n} WHERE least(h, w) >= 8)")
        parts.append(f"l{n + 1} AS (SELECT (l.y + a.o) // 2 AS y, (l.x + b.o) // 2 AS x, sum(num * a.k * b.k / 256.0) AS num, sum(den * a.k * b.k / 256.0) AS den FROM l{n} l, {k.format('a')}, {k.format('b')}, h{n + 1} h WHERE (l.y + a.o) % 2 = 0 AND (l.x + b.o) % 2 = 0 AND l.y + a.o BETWEEN 0 AND 2 * h.h - 2 AND l.x + b.o BETWEEN 0 AND 2 * h.w - 2 GROUP BY 1, 2)")
    own = "CASE WHEN l.den > 1e-6 THEN l.num / l.den ELSE 0 END"
    parts.append(f"e{levels} AS (SELECT y, x, {own} AS est FROM l{levels} l)")
    for n in reversed(range(levels)):
        parts.append(f"u{n} AS (SELECT 2 * e.y + a.o AS y, 2 * e.x + b.o AS x, sum(est * a.k * b.k) / sum(a.k * b.k) AS up FROM e{n + 1} e, {k.format('a')}, {k.format('b')} GROUP BY 1, 2)")
        parts.append(f"e{n} AS (SELECT l.y, l.x, CASE WHEN up IS NULL THEN {own} ELSE least(den, 1) * {own} + (1 - least(den, 1)) * up END AS est FROM l{n} l LEFT JOIN u{n} USING (y, x))")
    return "WITH " + ", ".join(parts) + " SELECT g.y, g.x, round(CASE WHEN known THEN value ELSE est END, 6) AS value FROM g JOIN e0 USING (y, x)"


@query(pyramid_sql(7))
def stn26_continued(spark, sf_dir):
    return Y.pulled_and_pushed(*holes(spark, sf_dir)).select("y", "x", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE g AS ({HOLES}), n AS (SELECT p.y, p.x, p.known, count(q.value) AS c FROM g p JOIN g q ON abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY 1, 2, 3),
r AS (SELECT 0 AS step, list({{'y': y, 'x': x, 'v': value, 'k': known}}) AS a FROM g UNION ALL
  SELECT step + 1, (SELECT list({{'y': p.y, 'x': p.x, 'v': v, 'k': k}}) FROM (SELECT p.y, p.x, any_value(p.k) AS k, CASE WHEN any_value(p.k) THEN any_value(p.v) ELSE (coalesce(sum(q.v), 0) + (4 - count(q.v)) * any_value(p.v)) / 4 END AS v
    FROM (SELECT unnest(a, recursive := true)) p LEFT JOIN (SELECT unnest(a, recursive := true)) q ON abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY 1, 2) p) FROM r WHERE step < 12)
SELECT y, x, round(v, 6) AS value FROM (SELECT unnest(a, recursive := true) FROM r WHERE step = 12)""")
def stn27_relaxed(spark, sf_dir):
    g, *_ = holes(spark, sf_dir)
    return T.relaxed(g, 12, cut, per_pass=5, size=64).select("y", "x", F.round("value", 6).alias("value"))


# Regions.


def region_sql(mask: str, eight: bool) -> str:
    near = "greatest(abs(p.y - m.y), abs(p.x - m.x)) = 1" if eight else "abs(p.y - m.y) + abs(p.x - m.x) = 1"
    return f"""WITH RECURSIVE m AS ({mask}), r(y, x, label) AS (SELECT y, x, y * 50 + x FROM m UNION SELECT m.y, m.x, p.label FROM r p JOIN m ON {near} AND p.label < m.y * 50 + m.x), l AS (SELECT y, x, min(label) AS label FROM r GROUP BY 1, 2)"""


@query(f"""{region_sql(f"SELECT y, x, value FROM ({GRID}) WHERE value % 7 < 4", False)}
SELECT label, count(*) AS area, round(avg(y), 6) AS y, round(avg(x), 6) AS x, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, max(value) AS peak, round(least(max(y) - min(y) + 1, max(x) - min(x) + 1) / greatest(max(y) - min(y) + 1, max(x) - min(x) + 1), 6) AS roundness, round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS filling
FROM l JOIN m USING (y, x) GROUP BY 1""")
def stn44_regions(spark, sf_dir):
    m = grid(spark, sf_dir).where("value % 7 < 4")
    d = B.regions(B.labelled(m, width=50, size=16).join(m, ["y", "x"]))
    return d.select("label", "area", "h", "w", "peak", *rounded(y=F.col("y"), x=F.col("x"), roundness=F.col("roundness"), filling=F.col("filling")))


@query(f"""WITH s AS (SELECT y, x FROM ({GRID}) WHERE value % 97 < 4), w AS (SELECT DISTINCT g.y, g.x FROM ({GRID}) g JOIN s ON abs(g.y - s.y) + abs(g.x - s.x) <= 1),
marks AS (SELECT * FROM ({region_sql("SELECT y, x FROM w", True)} SELECT * FROM l))
SELECT label, count(*) AS area, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM marks GROUP BY 1 HAVING count(*) >= 6""")
def stn49_marks(spark, sf_dir):
    g = grid(spark, sf_dir)
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    wide = g.where("value % 97 < 4").select("y", "x", o.alias("o")).select((F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).distinct()
    marks = B.labelled(g.join(wide, ["y", "x"], "left_semi"), width=50, eight=True, size=16)
    return marks.groupBy("label").agg(F.count("*").alias("area"), *rounded(y=F.avg("y"), x=F.avg("x"))).where("area >= 6")


# Greedy selections.

PEAKS = "SELECT c_custkey AS id, c_acctbal / 25 AS x, c_nationkey * 4.0 AS y, floor(c_acctbal / 400) AS strength FROM customer"


def peaks(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 25).alias("x"), (F.col("c_nationkey") * 4.0).alias("y"), F.floor(F.col("c_acctbal") / 400).alias("strength"))


def greedy_sql(radius: float) -> str:
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY strength DESC, id) AS n FROM ({PEAKS})),
r AS (SELECT 0::BIGINT AS n, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept UNION ALL
  SELECT o.n, CASE WHEN len(list_filter(kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 <= {radius * radius})) = 0 THEN list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y}}) ELSE kept END FROM r JOIN o ON o.n = r.n + 1)
SELECT unnest(list_transform(kept, lambda k: k.id)) AS id FROM r WHERE n = (SELECT max(n) FROM o)"""


@query(greedy_sql(6.0))
def srt06_suppressed(spark, sf_dir):
    return L.suppressed(peaks(spark, sf_dir), 6.0).select("id")


@query(greedy_sql(3.0))
def srt07_suppressed_close(spark, sf_dir):
    return L.suppressed(peaks(spark, sf_dir), 3.0).select("id")
