"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS ring, l_quantity AS v FROM lineitem),
s AS (SELECT ring, median(v) AS mid, count(v) AS n FROM p GROUP BY ring HAVING count(v) >= 30),
d AS (SELECT p.ring, median(abs(v - mid)) AS mad FROM p JOIN s USING (ring) GROUP BY p.ring)
SELECT l_orderkey, l_linenumber, ring, round(CASE WHEN mad > 0 THEN (v - mid) / (1.4826 * mad) END, 6) AS residual
FROM p JOIN s USING (ring) JOIN d USING (ring)
""")
def win01_ring_normalised(spark, sf_dir):
    from ..operators.rings import normalise

    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 1000).alias("ring"), F.col("l_quantity").alias("v"))
    return normalise(p, ["ring"], "v", least=30).select("l_orderkey", "l_linenumber", "ring", F.round("residual", 6).alias("residual"))


RING = "CAST(floor(l_extendedprice / 1000) AS BIGINT)"


def items(spark, sf_dir):
    """Line items as pixels: a ring, a sector, a frame and a value."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
        F.floor(F.col("l_extendedprice") / 1000).alias("ring"), F.pmod("l_orderkey", F.lit(36)).alias("sector"), F.col("l_quantity").alias("v"),
    )


@query(f"""SELECT {RING} AS ring, count(*) AS n, round(median(l_quantity), 6) AS mid FROM lineitem GROUP BY 1 HAVING count(*) >= 30""")
def agg01_radial_profile(spark, sf_dir):
    return items(spark, sf_dir).groupBy("ring").agg(F.count("v").alias("n"), F.round(F.median("v"), 6).alias("mid")).where("n >= 30")


@query(f"""SELECT {RING} AS ring, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1""")
def agg02_ring_stats(spark, sf_dir):
    return items(spark, sf_dir).groupBy("ring").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query(f"""SELECT {RING} AS ring, round(quantile_cont(l_quantity, 0.16), 6) AS p16, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.84), 6) AS p84 FROM lineitem GROUP BY 1""")
def agg04_multi_quantile(spark, sf_dir):
    q = lambda p: F.round(F.percentile("v", F.lit(p)), 6)
    return items(spark, sf_dir).groupBy("ring").agg(q(0.16).alias("p16"), q(0.5).alias("p50"), q(0.84).alias("p84"))


@query(f"""SELECT ring, count(*) FILTER (n >= 5) AS covered, CAST(sum(n) AS BIGINT) AS n FROM
(SELECT {RING} AS ring, l_orderkey % 36 AS sector, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY ring""")
def agg05_sector_coverage(spark, sf_dir):
    s = items(spark, sf_dir).groupBy("ring", "sector").agg(F.count("*").alias("n"))
    return s.groupBy("ring").agg(F.count_if(F.col("n") >= 5).alias("covered"), F.sum("n").alias("n"))


@query("""WITH m AS (SELECT l_partkey, sum(w * v) / sum(w) AS mean, sqrt(greatest(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2, 0)) AS sd
  FROM (SELECT l_partkey, l_quantity AS v, 1 - l_discount AS w FROM lineitem) GROUP BY 1)
SELECT l_partkey, count(*) AS kept, round(sum((1 - l_discount) * l_quantity) / sum(1 - l_discount), 5) AS mean
FROM lineitem JOIN m USING (l_partkey) WHERE abs(l_quantity - mean) <= 1.5 * sd + 1e-6 GROUP BY 1""")
def agg11_rejecting_mean(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("w", 1 - F.col("l_discount"))
    mean = F.sum(F.col("w") * F.col("v")) / F.sum("w")
    m = d.groupBy("l_partkey").agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w") - mean * mean, F.lit(0.0))).alias("sd"))
    return d.join(m, "l_partkey").where(F.abs(F.col("v") - F.col("mean")) <= 1.5 * F.col("sd") + 1e-6).groupBy("l_partkey").agg(F.count("*").alias("kept"), F.round(mean, 5).alias("mean"))


@query("""SELECT l_returnflag, l_suppkey, round(sum((1 - l_discount) * l_quantity) / sum(1 - l_discount), 5) AS stacked FROM lineitem WHERE l_quantity < 48 GROUP BY 1, 2""")
def agg13_weighted_stack(spark, sf_dir):
    w = 1 - F.col("l_discount")
    return items(spark, sf_dir).where("v < 48").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum(w * F.col("v")) / F.sum(w), 5).alias("stacked"))


@query("""WITH c AS (SELECT l_partkey, avg(l_quantity) AS ref FROM lineitem GROUP BY 1),
k AS (SELECT l_suppkey, median(ref / l_quantity) AS k FROM lineitem JOIN c USING (l_partkey) GROUP BY 1)
SELECT l_suppkey, round(k / (SELECT exp(median(ln(k))) FROM k), 6) AS gain FROM k""")
def agg15_frame_gain(spark, sf_dir):
    d = items(spark, sf_dir)
    k = d.join(d.groupBy("l_partkey").agg(F.avg("v").alias("ref")), "l_partkey").groupBy("l_suppkey").agg(F.median(F.col("ref") / F.col("v")).alias("k"))
    gauge = k.agg(F.exp(F.median(F.log("k"))).alias("g")).withColumn("one", F.lit(1))
    return k.withColumn("one", F.lit(1)).join(gauge, "one").select("l_suppkey", F.round(F.col("k") / F.col("g"), 6).alias("gain"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS base, round(corr(l_extendedprice, l_quantity), 8) AS r FROM lineitem GROUP BY 1""")
def agg35_linear_fit(spark, sf_dir):
    y, x = "l_extendedprice", "v"
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("base"), F.round(F.corr(y, x), 8).alias("r"))


@query("""WITH p AS (SELECT l_orderkey % 36 AS bin, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1),
c AS (SELECT k, corr(p.a, q.b) AS r FROM p, range(36) t(k), p q WHERE q.bin = (p.bin + k) % 36 GROUP BY k)
SELECT count(*) AS turns, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS sd, round(max(r), 6) AS most FROM c WHERE k > 0""")
def agg38_rotation_null(spark, sf_dir):
    p = items(spark, sf_dir).groupBy("sector").agg(F.avg("v").alias("a"), F.avg("l_discount").alias("b"))
    turned = p.select("a", F.explode(F.sequence(F.lit(1), F.lit(35))).alias("k"), "sector").withColumn("bin", F.pmod(F.col("sector") + F.col("k"), F.lit(36)))
    r = turned.join(p.select(F.col("sector").alias("bin"), "b"), "bin").groupBy("k").agg(F.corr("a", "b").alias("r"))
    return r.agg(F.count("*").alias("turns"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("sd"), F.round(F.max("r"), 6).alias("most"))


@query(f"""SELECT l_orderkey, l_linenumber, round(((rank() OVER w - 1) + cume_dist() OVER w * count(*) OVER (PARTITION BY {RING})) / (2.0 * count(*) OVER (PARTITION BY {RING})), 8) AS mid_rank
FROM lineitem WINDOW w AS (PARTITION BY {RING} ORDER BY l_quantity)""")
def win02_radial_rank(spark, sf_dir):
    ring = Window.partitionBy("ring")
    w, n = ring.orderBy("v"), F.count("*").over(ring)
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round((F.rank().over(w) - 1 + F.cume_dist().over(w) * n) / (2.0 * n), 8).alias("mid_rank"))


@query(f"""WITH p AS (SELECT {RING} AS ring, median(l_quantity) AS mid FROM lineitem GROUP BY 1)
SELECT ring, round(avg(mid) OVER (ORDER BY ring ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS trend, lead(mid) OVER (ORDER BY ring) - mid > 0.5 AS rises FROM p""")
def win12_radial_trend(spark, sf_dir):
    p = items(spark, sf_dir).groupBy("ring").agg(F.median("v").alias("mid"))
    w = Window.orderBy("ring")  # one row per ring
    return p.select("ring", F.round(F.avg("mid").over(w.rowsBetween(-2, 2)), 6).alias("trend"), (F.lead("mid").over(w) - F.col("mid") > 0.5).alias("rises"))


@query("""SELECT event_type, count(*) AS changes FROM (SELECT event_type, sign(value - 50) <> lead(sign(value - 50)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c FROM events) WHERE c GROUP BY 1""")
def win19_sign_changes(spark, sf_dir):
    s = F.signum(F.col("value") - 50)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", (s != F.lead(s).over(w)).alias("c")).where("c").groupBy("event_type").agg(F.count("*").alias("changes"))


@query("""SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def joi01_two_joins(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000""")
def joi07_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def joi09_unmatched(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
b AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)
SELECT a.id AS a_id, b.id AS b_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM a, b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3""")
def joi14_within_radius(spark, sf_dir):
    from ..operators.match import radius_join, rounded

    return radius_join(*star_lists(spark, sf_dir), 3.0).withColumn("distance", rounded(F.col("distance"), 6))


def star_lists(spark, sf_dir):
    """Suppliers and customers as two lists (id, x, y) of stars."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return a, b


@query("""WITH a AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
b AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
p AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY d, a_id) AS rb FROM p WHERE d <= 3)
SELECT a_id, b_id, round(d, 6) AS distance FROM r WHERE ra = 1 AND rb = 1""")
def joi13_mutual_nearest(spark, sf_dir):
    from ..operators.match import mutual_nearest

    return mutual_nearest(*star_lists(spark, sf_dir), 3.0).withColumn("distance", F.round("distance", 6))


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 16""")
def srt04_brightest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(16)


@query("""SELECT p_partkey, round(((0 - degrees(atan2(p_size - 25.0, -(p_retailprice - 1400)))) % 360 + 360) % 360, 6) AS pa,
round(sqrt((p_size - 25.0) ** 2 + (p_retailprice - 1400) ** 2), 6) AS radius,
round(least(greatest((p_retailprice - 1000) / 800, 0), 1) ** 2 * (3 - 2 * least(greatest((p_retailprice - 1000) / 800, 0), 1)), 8) AS smooth,
CAST(round_even(least(greatest(p_retailprice / 2500, 0), 1) * 65535, 0) AS INTEGER) AS code,
round(-2.5 * log10(p_retailprice), 8) AS magnitude,
round(1 / (sin(radians(p_size)) + 0.50572 * pow(p_size + 6.07995, -1.6364)), 6) AS air_mass FROM part""")
def sca_geometry_and_tone(spark, sf_dir):
    from ..functions import scalar as S

    dx, dy, price = F.col("p_size") - F.lit(25.0), F.col("p_retailprice") - 1400, F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(S.position_angle(dx, dy), 6).alias("pa"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("radius"), F.round(S.smoothstep(price, 1000.0, 1800.0), 8).alias("smooth"),
        S.to_code(price / 2500).alias("code"), F.round(S.magnitude(price), 8).alias("magnitude"), F.round(S.air_mass(F.col("p_size").cast("double")), 6).alias("air_mass"),
    )


GRID = "SELECT CAST(p_partkey // 50 AS BIGINT) AS y, CAST(p_partkey % 50 AS BIGINT) AS x, p_retailprice AS value FROM part"


def grid(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("y"), F.pmod("p_partkey", F.lit(50)).alias("x"), F.col("p_retailprice").alias("value"))


@query(f"""WITH g AS ({GRID}), k(o, k) AS (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625))
SELECT g.y, g.x, round(sum(n.value * a.k * b.k) / sum(a.k * b.k), 6) AS smooth FROM g, k a, k b, g n WHERE n.x = g.x + a.o AND n.y = g.y + b.o GROUP BY 1, 2""")
def stn17_b3_smooth(spark, sf_dir):
    from ..operators.raster import b3

    return b3(grid(spark, sf_dir)).withColumn("smooth", F.round("smooth", 6))


@query(f"""WITH g AS ({GRID})
SELECT y // 2 AS y, x // 2 AS x, CASE WHEN count(value) = 4 THEN round(avg(value) FILTER (y % 2 = 0 AND x % 2 = 0), 6) END AS r, CASE WHEN count(value) = 4 THEN round(avg(value) FILTER (y % 2 <> x % 2), 6) END AS g, CASE WHEN count(value) = 4 THEN round(avg(value) FILTER (y % 2 = 1 AND x % 2 = 1), 6) END AS b FROM g GROUP BY 1, 2""")
def stn04_superpixels(spark, sf_dir):
    from ..operators.grid import superpixels

    return superpixels(grid(spark, sf_dir)).select("y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])
