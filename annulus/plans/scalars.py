"""Named queries over scalar functions that need both senses of an image, affine frames, curves and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from .catalogue import query, table
from .sky import rounded

NORTH, EAST, CENTRE, SCALE = (0.1, -0.9), (-1.0, -0.05), (400.5, 300.25), 60.0
N, E = S.unit(NORTH), S.unit(EAST)
DET = N[0] * E[1] - E[0] * N[1]


@query("""SELECT s_suppkey, round(((degrees(atan2(s_acctbal - 3000, -(s_nationkey * 300.0 - 3500))) - 30) % 360 + 360) % 360, 6) AS angle,
round(((30 + (((degrees(atan2(s_acctbal - 3000, -(s_nationkey * 300.0 - 3500))) - 30) % 360 + 360) % 360)) % 360 + 360) % 360, 6) AS back FROM supplier""")
def sca01_mirrored_angles(spark, sf_dir):
    pa = S.position_angle(F.col("s_acctbal") - 3000, F.col("s_nationkey") * 300.0 - 3500, 30.0, mirrored=True)
    return table(spark, sf_dir, "supplier").select("s_suppkey", *rounded(angle=pa, back=S.image_angle(pa, 30.0, mirrored=True)))


@query(f"""WITH p AS (SELECT p_partkey, p_retailprice / 400 AS r, p_size * 7.0 AS pa FROM part), q AS (SELECT *, {CENTRE[0]} + {SCALE} * (r * cos(radians(pa)) * {N[0]} + r * sin(radians(pa)) * {E[0]}) AS x, {CENTRE[1]} + {SCALE} * (r * cos(radians(pa)) * {N[1]} + r * sin(radians(pa)) * {E[1]}) AS y FROM p),
b AS (SELECT *, ({E[1]} * ((x - {CENTRE[0]}) / {SCALE}) - {E[0]} * ((y - {CENTRE[1]}) / {SCALE})) / {DET} AS a, ({N[0]} * ((y - {CENTRE[1]}) / {SCALE}) - {N[1]} * ((x - {CENTRE[0]}) / {SCALE})) / {DET} AS b FROM q)
SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(a * a + b * b), 6) AS radius, round(cos(atan2(b, a)), 6) AS north, round(sin(atan2(b, a)), 6) AS east FROM b""")
def sca10_affine_frame(spark, sf_dir):
    frame = (CENTRE, SCALE, NORTH, EAST)
    x, y = S.frame_to_pixel(F.col("p_retailprice") / 400, F.col("p_size") * 7.0, *frame)
    d = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    radius, angle = S.pixel_to_frame(F.col("x"), F.col("y"), *frame)
    return d.select("p_partkey", *rounded(x=F.col("x"), y=F.col("y"), radius=radius, north=F.cos(F.radians(angle)), east=F.sin(F.radians(angle))))


@query("""SELECT s_suppkey, round(2 * s_acctbal + 0.5 - 0.5 * (1 + 0.01 * s_nationkey - 0.02), 8) AS move_x, round(2 * (s_acctbal / 3) + 0.5 - 0.5 * (0.02 + 0.99), 8) AS move_y FROM supplier""")
def sca12_full_resolution(spark, sf_dir):
    m = S.full_resolution(F.array(1 + 0.01 * F.col("s_nationkey"), F.lit(-0.02), F.col("s_acctbal"), F.lit(0.02), F.lit(0.99), F.col("s_acctbal") / 3))
    return table(spark, sf_dir, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", *rounded(8, move_x=F.col("m")[2], move_y=F.col("m")[5]))


CURVE = "CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END"


@query(f"""WITH p AS (SELECT p_partkey, least(greatest((p_retailprice - 901) / 900, 0), 1) AS v FROM part) SELECT p_partkey, CAST(round_even({CURVE} * 65535, 0) AS INTEGER) AS deep, CAST(round_even({CURVE} * 255, 0) AS INTEGER) AS shown FROM p""")
def sca19_srgb_codes(spark, sf_dir):
    v = (F.col("p_retailprice") - 901) / 900
    return table(spark, sf_dir, "part").select("p_partkey", S.srgb_code(v).alias("deep"), S.srgb_code(v, 8).alias("shown"))


@query("""SELECT o_orderkey, epoch_us(date_trunc('second', o_orderdate)) + CAST(round_even((CASE WHEN o_orderpriority < '3' THEN 0.25::DOUBLE ELSE 0 END + (o_totalprice / 100000) / 2 - 7200::DOUBLE) * 1e6, 0) AS BIGINT) AS mid FROM orders""")
def sca44_mid_exposure(spark, sf_dir):
    taken = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy:MM:dd HH:mm:ss")
    fraction = F.when(F.col("o_orderpriority") < "3", "25").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.mid_exposure(taken, fraction, F.col("o_totalprice") / 100000, 2.0).alias("mid"))


@query("""SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size + 0.25 END::DOUBLE AS v FROM part""")
def sca48_decimal_comma(spark, sf_dir):
    number = F.translate(F.format_string("%.2f", F.col("p_size") + 0.25), ".", ",")
    label = F.when(F.col("p_size") > 5, F.concat(F.lit("HIP 7, V = "), number, F.lit(" mag"))).otherwise(F.concat(F.lit("V=? "), number))
    return table(spark, sf_dir, "part").select("p_partkey", S.labelled_magnitude(label).alias("v"))
