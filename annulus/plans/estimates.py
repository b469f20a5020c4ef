"""Named queries over robust fits, block bootstraps and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits as X
from ..operators import match as M
from ..operators import resample as S
from .catalogue import GRID, grid, query, table
from .sky import rounded

#: Star measurements: a magnitude, an air mass and a colour per line item.
STARS = "SELECT l_returnflag, -2.5 * log10(l_extendedprice) AS mag, 1 + 10 * l_discount AS airmass, l_tax * 10 - 0.4 AS colour FROM lineitem"


def stars(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_returnflag", (-2.5 * F.log10("l_extendedprice")).alias("mag"), (1 + 10 * F.col("l_discount")).alias("airmass"), (F.col("l_tax") * 10 - 0.4).alias("colour"), F.lit(1.0).alias("one"), (-(1 + 10 * F.col("l_discount"))).alias("minus_airmass"), (-(F.col("l_tax") * 10 - 0.4)).alias("minus_colour"))


def fit3_sql(name: str, source: str, keys: str, x: tuple[str, str, str], y: str) -> str:
    """CTE `name` (keys, n, c1, c2, c3, i11, i22, i33, det, ss): least squares on three columns by cofactors, and the diagonal of the inverse."""
    s = ", ".join(f"sum({x[i]} * {x[j]}) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum({x[i]} * {y}) AS b{i}" for i in range(3))
    cof = {(0, 0): "s11 * s22 - s12 * s12", (0, 1): "s02 * s12 - s01 * s22", (0, 2): "s01 * s12 - s02 * s11", (1, 1): "s00 * s22 - s02 * s02", (1, 2): "s01 * s02 - s00 * s12", (2, 2): "s00 * s11 - s01 * s01"}
    c = lambda i, j: f"({cof[min(i, j), max(i, j)]})"
    det = f"(s00 * {c(0, 0)} + s01 * {c(0, 1)} + s02 * {c(0, 2)})"
    coef = ", ".join(f"({' + '.join(f'{c(i, j)} * b{j}' for j in range(3))}) / {det} AS c{i + 1}" for i in range(3))
    key = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {key}n, yy, {coef}, {', '.join(f'{c(i, i)} / {det} AS i{i + 1}' for i in range(3))}, b0, b1, b2 FROM (SELECT {key}count(*) AS n, sum({y} * {y}) AS yy, {s} FROM {source} {f'GROUP BY {keys}' if keys else ''}))"


def rounds_sql(source: str, keys: str, x: tuple[str, str, str], y: str, *, clip: float, rounds: int, floor: float = 0.0, again: bool = False, about: bool = True) -> str:
    """CTEs k0 ... (source's columns, kept) and the fits f0 ... f`rounds` of robust rounds."""
    on = " AND ".join(f"f.{k} = k.{k}" for k in keys.split(", ")) if keys else "true"
    key = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    parts = [f"k0 AS (SELECT *, true AS kept FROM {source})"]
    for r in range(rounds):
        parts.append(fit3_sql(f"f{r}", f"(SELECT * FROM k{r} WHERE kept)", keys, x, y))
        parts.append(f"r{r} AS (SELECT k.*, {y} - c1 * {x[0]} - c2 * {x[1]} - c3 * {x[2]} AS res FROM k{r} k JOIN f{r} f ON {on})")
        mid = "median(res)" if about else "0"
        parts.append(f"m{r} AS (SELECT {key}{mid} AS mid FROM r{r} WHERE kept {group})")
        parts.append(f"o{r} AS (SELECT k.*, abs(res - mid) AS off FROM r{r} k JOIN m{r} f ON {on})")
        parts.append(f"s{r} AS (SELECT {key}median(off) AS mad FROM o{r} WHERE kept {group})")
        parts.append(f"k{r + 1} AS (SELECT k.* EXCLUDE (res, off, kept), {'' if again else 'kept AND '}off <= {clip} * greatest(1.4826 * mad, {floor}) AS kept FROM o{r} k JOIN s{r} f ON {on})")
    parts.append(fit3_sql(f"f{rounds}", f"(SELECT * FROM k{rounds} WHERE kept)", keys, x, y))
    return ", ".join(parts)


RSS = "greatest(yy - 2 * (c1 * b0 + c2 * b1 + c3 * b2) + (c1 * b0 + c2 * b1 + c3 * b2), 0)"


@query(f"""WITH st AS (SELECT *, 1.0::DOUBLE AS one, -airmass AS ma, -colour AS mc FROM ({STARS})), {rounds_sql("st", "l_returnflag", ("one", "ma", "mc"), "mag", clip=2.5, rounds=6, floor=0.02)},
p AS (SELECT l_returnflag, avg((mag - c1 - c2 * ma - c3 * mc) ** 2) * count(*) / (count(*) - 3) AS v FROM k6 JOIN f6 USING (l_returnflag) WHERE kept GROUP BY 1)
SELECT l_returnflag, n, round(c1, 7) AS zero_point, round(c2, 7) AS extinction, round(c3, 7) AS colour_term, round(sqrt(v * i1), 8) AS zero_point_err, round(sqrt(v * i2), 8) AS extinction_err, round(sqrt(v * i3), 8) AS colour_term_err, round(sqrt(v), 7) AS spread FROM f6 JOIN p USING (l_returnflag)""")
def agg26_zero_point(spark, sf_dir):
    fit, _ = X.robust_linear(stars(spark, sf_dir), "mag", ("one", "minus_airmass", "minus_colour"), keys=("l_returnflag",), clip=2.5, rounds=6, floor=0.02, large=True)
    c, e = (lambda k: F.col("coef")[k]), (lambda k: F.sqrt(F.col("covariance")[4 * k]))
    return fit.select("l_returnflag", "n", *rounded(7, zero_point=c(0), extinction=c(1), colour_term=c(2), spread=F.col("spread")), *rounded(8, zero_point_err=e(0), extinction_err=e(1), colour_term_err=e(2)))


@query(f"""WITH g AS ({GRID}), h AS (SELECT max(y) + 1 AS h FROM g), px AS (SELECT y, x, value AS z, 1.0::DOUBLE AS one, (y - h / 2) / (h / 2) AS ty, (x - 25) / 25.0::DOUBLE AS tx FROM g, h),
sky AS (SELECT * FROM px WHERE (x - 24) ** 2 + (y - 20) ** 2 >= 64), {rounds_sql("sky", "", ("one", "ty", "tx"), "z", clip=2.5, rounds=5, again=True)}
SELECT y, x, round(c1 + c2 * ty + c3 * tx, 6) AS sky FROM px, f5""")
def agg16_sky(spark, sf_dir):
    g = grid(spark, sf_dir)
    height = int(g.agg(F.max("y")).first()[0]) + 1
    far = (F.col("x") - 24) * (F.col("x") - 24) + (F.col("y") - 20) * (F.col("y") - 20) >= 64
    sky, _ = X.sky_surface(g, far, height, 50, order=1, least=40)
    return sky.select("y", "x", F.round("sky", 6).alias("sky"))


# Block bootstraps over 360 cells of an angle and three instruments.

CELLS = """SELECT l_returnflag, CAST(l_partkey % 360 AS BIGINT) AS cell, median(l_extendedprice) / 1000 AS y, median(l_quantity) AS x FROM lineitem GROUP BY 1, 2"""
BLOCKS = 30


def cells(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.pmod("l_partkey", F.lit(360)).alias("cell"))
    return d.agg((F.median("l_extendedprice") / 1000).alias("y"), F.median("l_quantity").alias("x"))


def weights_sql(source: str, keys: str, replicates: int, salt: str) -> str:
    """CTE w (keys, replicate, block, weight) of the blocks of `source`."""
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY block) - 1 AS nth, count(*) OVER (PARTITION BY {keys}) AS nb FROM (SELECT DISTINCT {keys}, block FROM {source})),
w AS (SELECT {keys}, replicate, block, weight FROM b JOIN (SELECT {keys}, r.range AS replicate, ('0x' || substr(md5('{salt}:' || r.range || ':' || d.range), 1, 8))::BIGINT % nb AS nth, count(*) AS weight
  FROM (SELECT DISTINCT {keys}, nb FROM b) q, range({replicates}) r, range(400) d WHERE d.range < nb GROUP BY ALL) USING ({keys}, nth))"""


@query(f"""WITH c AS (SELECT *, cell // {BLOCKS} AS block FROM ({CELLS})), {weights_sql("c", "l_returnflag", 100, "7")} SELECT l_returnflag, replicate::INTEGER AS replicate, block, weight FROM w""")
def agg32_block_weights(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("block", F.floor(F.col("cell") / BLOCKS))
    return S.block_weights(c, 100, keys=("l_returnflag",))


@query(f"""WITH c AS (SELECT *, cell // {BLOCKS} AS block FROM ({CELLS})), {weights_sql("c", "l_returnflag", 100, "7")},
base AS (SELECT l_returnflag, count(*) AS n, median(y) / median(x) AS a, median(y / x) AS b FROM c GROUP BY 1),
e AS (SELECT l_returnflag, replicate, median(y) / median(x) AS a, median(y / x) AS b FROM (SELECT c.*, replicate, unnest(range(weight)) FROM c JOIN w USING (l_returnflag, block)) GROUP BY 1, 2),
s AS (SELECT l_returnflag, stddev_pop(a) AS ae, quantile_cont(a, 0.16) AS a16, quantile_cont(a, 0.84) AS a84, stddev_pop(b) AS be, quantile_cont(b, 0.16) AS b16, quantile_cont(b, 0.84) AS b84 FROM e GROUP BY 1)
SELECT l_returnflag, n, round(a, 7) AS ratio_of_medians, round(ae, 7) AS ratio_of_medians_err, round(a16, 7) AS ratio_of_medians_p16, round(a84, 7) AS ratio_of_medians_p84, round(b, 7) AS median_of_ratios, round(be, 7) AS median_of_ratios_err, round(b16, 7) AS median_of_ratios_p16, round(b84, 7) AS median_of_ratios_p84 FROM base JOIN s USING (l_returnflag)""")
def agg33_paired_ratios(spark, sf_dir):
    d = S.paired_ratios(cells(spark, sf_dir), block=BLOCKS, replicates=100, keys=("l_returnflag",))
    return d.select("l_returnflag", "n", *rounded(7, **{c: F.col(c) for c in d.columns if c not in ("l_returnflag", "n")}))


ZENITH = 40.0
TURN = f"cos(radians({ZENITH}))", f"sin(radians({ZENITH}))"


@query(f"""WITH c AS (SELECT l_returnflag, cell, (cell // 10)::DOUBLE AS block, ln(y / x) AS v, 1.0::DOUBLE AS one, cos(radians(cell)) AS co, sin(radians(cell)) AS si FROM ({CELLS})),
{rounds_sql("c", "l_returnflag", ("one", "co", "si"), "v", clip=3.0, rounds=4, again=True, about=False)}, {weights_sql("c", "l_returnflag", 100, "3")},
again AS (SELECT k4.*, replicate FROM (SELECT k4.*, replicate, unnest(range(weight)) AS u FROM k4 JOIN w USING (l_returnflag, block) WHERE kept) k4), {fit3_sql("e", "again", "l_returnflag, replicate", ("one", "co", "si"), "v")},
s AS (SELECT l_returnflag, stddev_pop(c2 * {TURN[0]} + c3 * {TURN[1]}) AS ez, stddev_pop(-c2 * {TURN[1]} + c3 * {TURN[0]}) AS ea FROM e GROUP BY 1), t AS (SELECT l_returnflag, count(v) AS n_finite FROM c GROUP BY 1)
SELECT l_returnflag, n, n_finite, round(c2 * {TURN[0]} + c3 * {TURN[1]}, 7) AS to_zenith, round(ez, 7) AS to_zenith_err, round(-c2 * {TURN[1]} + c3 * {TURN[0]}, 7) AS across, round(ea, 7) AS across_err, round(sqrt(c2 * c2 + c3 * c3), 7) AS amplitude, round((degrees(atan2(c3, c2)) + 360) % 360, 5) AS direction
FROM f4 JOIN s USING (l_returnflag) JOIN t USING (l_returnflag)""")
def agg36_dipole(spark, sf_dir):
    c = cells(spark, sf_dir).select("l_returnflag", "cell", F.col("cell").cast("double").alias("angle"), F.ln(F.col("y") / F.col("x")).alias("v"))
    d = S.dipole(c, zenith=ZENITH, replicates=100, keys=("l_returnflag",))
    named = ("to_zenith", "to_zenith_err", "across", "across_err", "amplitude")
    return d.select("l_returnflag", "n", "n_finite", *rounded(7, **{k: F.col(k) for k in named}), F.round("direction", 5).alias("direction"))


@query(f"""WITH st AS (SELECT *, 1.0::DOUBLE AS one, -airmass AS ma, -colour AS mc FROM ({STARS})), {fit3_sql("f", "st", "l_returnflag", ("one", "ma", "mc"), "mag")},
a AS (SELECT l_returnflag, 'constant' AS model, count(*) AS n, avg(mag) AS zero_point, sqrt(var_samp(mag)) AS rms FROM st GROUP BY 1),
b AS (SELECT l_returnflag, 'extinction' AS model, count(*) AS n, regr_intercept(mag, ma) AS zero_point, sqrt((regr_syy(mag, ma) - regr_sxy(mag, ma) ** 2 / regr_sxx(mag, ma)) / (count(*) - 2)) AS rms FROM st GROUP BY 1),
c AS (SELECT l_returnflag, 'extinction and colour' AS model, any_value(n) AS n, any_value(c1) AS zero_point, sqrt(sum((mag - c1 - c2 * ma - c3 * mc) ** 2) / (any_value(n) - 3)) AS rms FROM st JOIN f USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, model, n, round(zero_point, 7) AS zero_point, round(rms, 7) AS rms FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def agg27_nested_models(spark, sf_dir):
    models = {"constant": ("one",), "extinction": ("one", "minus_airmass"), "extinction and colour": ("one", "minus_airmass", "minus_colour")}
    d = X.compared(stars(spark, sf_dir), "mag", models, keys=("l_returnflag",))
    return d.select("l_returnflag", "model", "n", *rounded(7, zero_point=F.col("coef")[0], rms=F.col("rms")))


LISTS = """a AS (SELECT s_suppkey AS id, s_acctbal / 10 AS x, s_nationkey * 20.0 AS y FROM supplier), b AS (SELECT id, x + 7.3 + 0.02 * y AS x, y - 4.1 + 0.01 * x AS y FROM a)"""


def shift_sql(tolerances: tuple[float, ...]) -> str:
    parts = [f"{LISTS}, z0 AS (SELECT 6.0::DOUBLE AS dx, -3.0::DOUBLE AS dy, 0::BIGINT AS matched)"]
    for k, t in enumerate(tolerances):
        parts.append(f"p{k} AS (SELECT a.id, b.x - a.x AS ox, b.y - a.y AS oy, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((b.x - dx - a.x) ** 2 + (b.y - dy - a.y) ** 2), b.id) AS n FROM a, b, z{k} WHERE sqrt((b.x - dx - a.x) ** 2 + (b.y - dy - a.y) ** 2) <= {t})")
        parts.append(f"q{k} AS (SELECT median(ox) AS nx, median(oy) AS ny, count(*) AS n FROM p{k} WHERE n = 1), z{k + 1} AS (SELECT CASE WHEN n >= 3 THEN nx ELSE dx END AS dx, CASE WHEN n >= 3 THEN ny ELSE dy END AS dy, CASE WHEN n >= 3 THEN n ELSE matched END AS matched FROM z{k}, q{k})")
    return f"WITH {', '.join(parts)} SELECT round(dx, 6) AS dx, round(dy, 6) AS dy, matched FROM z{len(tolerances)}"


@query(shift_sql((6.0, 3.0, 1.8)))
def joi15_refined_shift(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 20.0).alias("y"))
    b = a.select("id", (F.col("x") + 7.3 + 0.02 * F.col("y")).alias("x"), (F.col("y") - 4.1 + 0.01 * F.col("x")).alias("y"))
    start = spark.createDataFrame([(6.0, -3.0)], "dx double, dy double")
    d = M.refined_shift(a, b, start, (6.0, 3.0, 1.8))
    return d.select(*rounded(dx=F.col("dx"), dy=F.col("dy")), "matched")
