"""Named queries over frames: pixel geometry, valid domains, per-frame statistics, key joins, sorts and Gaussian stencils."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..functions import scalar as S
from ..operators import grid as G
from ..operators import match as M
from ..operators import raster as T
from ..operators import rings as R
from ..operators.lineage import dealt
from ..operators.order import numbered
from ..operators.quantiles import exact_median, exact_quantiles
from ..operators.raster import of_keys
from .catalogue import GRID, RING, grid, items, query, table
from .sky import rounded

RGB = "l_extendedprice AS r, l_quantity * 1000 AS g, l_tax * 100000 AS b"


def colours(spark, sf_dir):
    """Line items as pixels of three channels, with a position."""
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("r"), (F.col("l_quantity") * 1000).alias("g"), (F.col("l_tax") * 100000).alias("b"), (F.col("l_quantity") / 20).alias("radius"), "l_discount")


# Pixels one by one.


@query(f"""WITH g AS ({GRID}), d AS (SELECT *, sqrt((x - 24.5) ** 2 + (y - 20.25) ** 2) AS d FROM g)
SELECT y, x, round(d / 8, 8) AS radii, round(((degrees(atan2(-(x - 24.5), -(y - 20.25))) + 720) % 360 + 360) % 360, 6) AS angle, d <= 8 + 1.5 AS in_moon FROM d""")
def sca05_pixel_geometry(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    angle = F.pmod(F.degrees(F.atan2(-(x - 24.5), -(y - 20.25))) + 720, F.lit(360.0))
    return grid(spark, sf_dir).select("y", "x", *rounded(8, radii=P.in_radii(x, y, 24.5, 20.25, 8.0)), *rounded(angle=angle), P.in_disc(x, y, 24.5, 20.25, 8.0, 1.5).alias("in_moon"))


@query("""SELECT s_suppkey, round((s_acctbal + 0.5) * 0.25 - 0.5, 6) AS sun_x, round((s_nationkey::DOUBLE + 0.5) * 0.25 - 0.5, 6) AS sun_y, round(s_acctbal * 0.25, 6) AS radius, round(s_acctbal - 12, 6) AS moved_x, round(s_nationkey::DOUBLE + 3.5, 6) AS moved_y FROM supplier""")
def sca08_geometry_moved(spark, sf_dir):
    x, y = F.col("s_acctbal"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", *rounded(sun_x=P.scaled(x, 0.25), sun_y=P.scaled(y, 0.25), radius=x * 0.25, moved_x=x - 12, moved_y=y + 3.5))


@query("""SELECT p_partkey, CAST(round_even(least(greatest(p_retailprice / 1500, 0), 1) * 65535, 0) AS INTEGER) AS code,
CAST(floor(255 * pow(least(greatest((p_retailprice - 900) / 600, 0), 1), 0.7)) AS INTEGER) AS shown, CASE WHEN p_size > 5 THEN p_size / 50.0 ELSE 0.0 END AS alpha FROM part""")
def sca20_display_codes(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", P.to_unsigned(price / 1500).alias("code"), P.display_byte(price, 900.0, 1500.0, 0.7).alias("shown"), P.layer_alpha(F.col("p_size") / 50.0, F.col("p_size") > 5).alias("alpha"))


LUM = "(0.25 * {} + 0.5 * {} + 0.25 * {})"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {RGB} FROM lineitem), t AS (SELECT *, {LUM.format('r', 'g', 'b')} AS lum FROM p),
c AS (SELECT *, pow(CASE WHEN lum > 0 THEN least(greatest(r / lum, 0.2), 3) ELSE 1 END, 1 / 2.2) AS cr, pow(CASE WHEN lum > 0 THEN least(greatest(g / lum, 0.2), 3) ELSE 1 END, 1 / 2.2) AS cg, pow(CASE WHEN lum > 0 THEN least(greatest(b / lum, 0.2), 3) ELSE 1 END, 1 / 2.2) AS cb FROM t),
u AS (SELECT *, greatest({LUM.format('cr', 'cg', 'cb')}, 1e-6) AS unit FROM c) SELECT l_orderkey, l_linenumber, round(cr / unit, 6) AS red, round(cg / unit, 6) AS green, round(cb / unit, 6) AS blue FROM u""")
def sca23_display_chroma(spark, sf_dir):
    red, green, blue = P.display_chroma((F.col("r"), F.col("g"), F.col("b")), S.luminance, 2.2)
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", *rounded(red=red, green=green, blue=blue))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {RGB}, l_quantity / 20 AS radius FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN radius BETWEEN 0.95 AND 1.2 THEN least(greatest(CASE WHEN g > 0 THEN r / g ELSE 0 END - 1.15, 0), 0.45) / 0.45 ELSE 0 END, 6) AS weight FROM p""")
def sca25_red_weight(spark, sf_dir):
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(P.red_weight(F.col("r"), F.col("g"), F.col("radius")), 6).alias("weight"))


@query(f"""WITH g AS ({GRID}), u AS (SELECT y, x, (x - 24.5) / 8 AS u, (y - 20.25) / 8 AS v FROM g)
SELECT y, x, 3.5::DOUBLE AS flat, round(3.5 + 0.2 * u - 0.1 * v, 8) AS plane, round(3.5 + 0.2 * u - 0.1 * v + 0.03 * u * u + 0.01 * u * v - 0.02 * v * v, 8) AS curved FROM u""")
def sca29_sky_models(spark, sf_dir):
    u, v = (F.col("x") - 24.5) / 8, (F.col("y") - 20.25) / 8
    return grid(spark, sf_dir).select("y", "x", P.sky(u, v, (3.5,)).alias("flat"), *rounded(8, plane=P.sky(u, v, (3.5, 0.2, -0.1)), curved=P.sky(u, v, (3.5, 0.2, -0.1, 0.03, 0.01, -0.02))))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {RGB} FROM lineitem) SELECT l_orderkey, l_linenumber, round(r * 0.6 + g * 0.3 - b * 0.1, 4) AS red, round(r * 0.2 + g * 0.7 + b * 0.1, 4) AS green, round(g * 0.25 + b * 0.75 - r * 0.05, 4) AS blue FROM p""")
def sca30_camera_channels(spark, sf_dir):
    rgb = F.col("r"), F.col("g"), F.col("b")
    rows = {"red": (0.6, 0.3, -0.1), "green": (0.2, 0.7, 0.1), "blue": (-0.05, 0.25, 0.75)}
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", *rounded(4, **{k: P.mixed_channel(rgb, m) for k, m in rows.items()}))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {RGB} FROM lineitem) SELECT l_orderkey, l_linenumber, round(r * 0.2 + g * 0.7 + b * 0.1, 4) AS green FROM p""")
def sca31_camera_green(spark, sf_dir):
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(P.mixed_channel((F.col("r"), F.col("g"), F.col("b")), (0.2, 0.7, 0.1)), 4).alias("green"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - 2000) / 6000, 0), 1) * least(greatest((90000 - l_extendedprice) / 16200, 0), 1) * l_quantity, 6) AS weight FROM lineitem""")
def sca33_exposure_window(spark, sf_dir):
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(P.exposure_window(F.col("l_extendedprice"), F.col("v"), 2000.0, 90000.0), 6).alias("weight"))


@query("""WITH d AS (SELECT p_partkey, p_retailprice - 1200 AS d, abs(p_retailprice - 1200) / greatest(3.0 * p_size, 1e-12) AS z FROM part), t AS (SELECT *, 1 / (1 + 0.3275911 * z) AS t FROM d)
SELECT p_partkey, round(d * sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z)), 5) AS gated FROM t""")
def sca36_noise_gate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.noise_gate(F.col("p_retailprice") - 1200, F.col("p_size"), 3.0), 5).alias("gated"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S.%f') AS stamp, 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.raw' AS name FROM events)
SELECT event_id, epoch_us(strptime(regexp_extract(stamp, '^(\\d{4}:\\d\\d:\\d\\d \\d\\d:\\d\\d:\\d\\d)', 1), '%Y:%m:%d %H:%M:%S')) + CAST(rpad(regexp_extract(stamp, '\\.(\\d+)$', 1), 6, '0') AS BIGINT) AS micros,
epoch_us(strptime(regexp_extract(name, '_(\\d{8}_\\d{6})\\.', 1), '%Y%m%d_%H%M%S')) AS from_name FROM t""")
def sca50_timestamps(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss.SSSSSS").alias("stamp"), F.concat(F.lit("IMG_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".raw")).alias("name"))
    whole = F.to_timestamp(F.regexp_extract("stamp", r"^(\d{4}:\d\d:\d\d \d\d:\d\d:\d\d)", 1), "yyyy:MM:dd HH:mm:ss")
    part = F.rpad(F.regexp_extract("stamp", r"\.(\d+)$", 1), 6, "0").cast("long")
    named = F.to_timestamp(F.regexp_extract("name", r"_(\d{8}_\d{6})\.", 1), "yyyyMMdd_HHmmss")
    return t.select("event_id", (F.unix_micros(whole) + part).alias("micros"), F.unix_micros(named).alias("from_name"))


# Filters.


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {RGB}, l_quantity / 20 AS radius, l_discount FROM lineitem)
SELECT l_orderkey, l_linenumber FROM p WHERE isfinite(r) AND isfinite(g) AND isfinite(b) AND NOT l_discount > 0.08 AND r / 105000 >= 0.1 AND {LUM.format('r', 'g', 'b')} > 0 AND radius > 1.05""")
def fil01_valid_domain(spark, sf_dir):
    d = colours(spark, sf_dir)
    for c in "rgb":
        d = d.where(R.present(F.col(c)).isNotNull() & (F.abs(F.col(c)) < float("inf")))
    return d.where((F.col("l_discount") <= 0.08) & (F.col("r") / 105000 >= 0.1)).where(S.luminance(F.col("r"), F.col("g"), F.col("b")) > 0).where("radius > 1.05").select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, user_id, value FROM events WHERE value < 48 AND value >= 2 AND event_type IN ('view', 'click')""")
def fil02_usable_window(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value < 48 and value >= 2 and event_type in ('view', 'click')").select("event_id", "user_id", "value")


@query(f"""WITH g AS ({GRID}), m AS (SELECT median(value) AS mid FROM g), s AS (SELECT greatest(median(abs(value - mid)) * 1.4826, 1) AS mad FROM g, m)
SELECT y, x FROM g, m, s WHERE value > mid + 1.2 * mad OR value < mid - 1.2 * mad""")
def fil05_static_hot(spark, sf_dir):
    g = grid(spark, sf_dir)
    g = of_keys(g, (), exact_median(g, (), "value").select(F.col("median").alias("mid"))).withColumn("off", F.abs(F.col("value") - F.col("mid")))
    g = of_keys(g, (), exact_median(g, (), "off").select(F.col("median").alias("mad")))
    return g.where(F.abs(F.col("value") - F.col("mid")) > 1.2 * F.greatest(R.MAD * F.col("mad"), F.lit(1.0))).select("y", "x")


# Joins by key.


@query("""SELECT a.l_orderkey, a.l_linenumber, round(a.l_quantity - b.l_quantity, 6) AS difference FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1""")
def joi02_suffixes(spark, sf_dir):
    d = items(spark, sf_dir)
    a, b = d.select("l_orderkey", "l_linenumber", F.col("v").alias("v_a")), d.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("v").alias("v_b"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(F.col("v_a") - F.col("v_b"), 6).alias("difference"))


@query("""SELECT o_orderkey, c_name, c_mktsegment, round(o_totalprice, 4) AS flux FROM orders JOIN customer ON o_custkey = c_custkey""")
def joi03_identified(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "c_name", "c_mktsegment", F.round("o_totalprice", 4).alias("flux"))


@query("""SELECT o_orderkey, c_custkey, round(-2.5 * log10(o_totalprice) - c_acctbal / 1000, 6) AS residual FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 200000""")
def joi04_join_and_filter(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return o.where("o_totalprice > 200000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", F.round(S.magnitude(F.col("o_totalprice")) - F.col("c_acctbal") / 1000, 6).alias("residual"))


@query("""WITH j AS (SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal > 0 THEN -2.5 * log10(s_acctbal) END AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT l_orderkey, l_linenumber, round(m, 6) AS m FROM j WHERE m IS NOT NULL""")
def joi05_finite(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), R.present(S.magnitude(F.col("s_acctbal"))).alias("m"))
    return items(spark, sf_dir).join(s, "l_suppkey").where(F.col("m").isNotNull()).select("l_orderkey", "l_linenumber", F.round("m", 6).alias("m"))


@query("""WITH a AS (SELECT l_orderkey, l_suppkey, count(*) AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_suppkey, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, round(v, 4) AS v, tax FROM a JOIN b USING (l_orderkey, l_suppkey)""")
def joi06_one_to_one(spark, sf_dir):
    d = dealt(items(spark, sf_dir), "l_orderkey", "l_suppkey")
    a, b = d.groupBy("l_orderkey", "l_suppkey").agg(F.sum("v").alias("v")), d.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_tax").alias("tax"))
    return M.one_to_one(a, b, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_suppkey", F.round("v", 4).alias("v"), "tax")


@query("""SELECT l_orderkey, l_linenumber, round(1 / (sin(radians(10 + s_nationkey * 3.0)) + 0.50572 * pow(10 + s_nationkey * 3.0 + 6.07995, -1.6364)), 6) AS mass FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def joi08_air_mass_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), S.air_mass(10 + F.col("s_nationkey") * 3.0).alias("mass"))
    return items(spark, sf_dir).join(s, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.round("mass", 6).alias("mass"))


@query("""WITH a AS (SELECT c_custkey AS det, coalesce('H' || nullif(c_nationkey % 5, 0), 'T' || c_mktsegment) AS key FROM customer), b AS (SELECT coalesce('H' || nullif(s_nationkey % 7, 0), 'T' || s_name) AS key, min(s_suppkey) AS other FROM supplier GROUP BY 1)
SELECT det, key, other FROM a LEFT JOIN b USING (key)""")
def joi12_cross_identified(spark, sf_dir):
    key = lambda n, k, other: F.coalesce(F.concat(F.lit("H"), F.when(F.col(n) % k != 0, (F.col(n) % k).cast("string"))), F.concat(F.lit("T"), other))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("det"), key("c_nationkey", 5, F.col("c_mktsegment")).alias("key"))
    b = table(spark, sf_dir, "supplier").groupBy(key("s_nationkey", 7, F.col("s_name")).alias("key")).agg(F.min("s_suppkey").alias("other"))
    return a.join(b, "key", "left").select("det", "key", "other")


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
SELECT a.id AS a_id, b.id AS b_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM s a JOIN s b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 4""")
def joi16_close_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return M.radius_join(s, s, 4.0).where("a_id < b_id").withColumn("distance", F.round("distance", 6))


# Statistics of frames and rings.


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)
SELECT CAST((l_extendedprice >= a)::INT + (l_extendedprice >= b)::INT + (l_extendedprice >= c)::INT AS INTEGER) AS ring, count(*) AS n, median(l_quantity) AS mid FROM lineitem, e GROUP BY 1""")
def agg03_quantile_rings(spark, sf_dir):
    d = items(spark, sf_dir)
    edges = exact_quantiles(d, (), "l_extendedprice", (0.25, 0.5, 0.75)).agg(F.collect_list("quantile").alias("edges"))  # three rows
    ring = F.size(F.filter("edges", lambda e: e <= F.col("l_extendedprice")))
    return exact_median(of_keys(d, (), edges).select(ring.alias("ring"), "v"), ("ring",), "v").select("ring", "n", F.col("median").alias("mid"))


@query(f"""SELECT l_returnflag, {RING} // 10 AS ring, count(*) AS n, round(avg((l_quantity > 45)::INT), 8) AS saturated, round(avg(l_quantity) FILTER (l_quantity <= 45), 6) AS mean, round(sqrt(avg((l_tax - l_discount) ** 2)), 8) AS fine FROM lineitem GROUP BY 1, 2""")
def agg06_frame_rings(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("ring", F.floor(F.col("ring") / 10)).withColumn("d", F.col("l_tax") - F.col("l_discount"))
    return d.groupBy("l_returnflag", "ring").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("v") > 45).cast("int")), 8).alias("saturated"), F.round(F.avg(F.when(F.col("v") <= 45, F.col("v"))), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 8).alias("fine"),
    )


@query("""SELECT p_size, string_agg(p_name, '|' ORDER BY p_name, p_partkey) AS files FROM part GROUP BY 1""")
def agg09_exposure_lists(spark, sf_dir):
    files = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))), lambda s: s["p_name"]), "|")
    return table(spark, sf_dir, "part").groupBy("p_size").agg(files.alias("files"))


@query("""SELECT l_linenumber, l_partkey, count(*) AS n, median(l_quantity) AS dark FROM lineitem GROUP BY 1, 2""")
def agg10_master_darks(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_linenumber", "l_partkey").agg(F.count("*").alias("n"), F.median("v").alias("dark"))


@query("""SELECT l_returnflag, l_partkey, round(sum(l_extendedprice * l_quantity * (1 + l_tax)) / sum(l_quantity), 4) AS composed FROM lineitem GROUP BY 1, 2""")
def agg14_composed(spark, sf_dir):
    value = F.sum(F.col("l_extendedprice") * F.col("v") * (1 + F.col("l_tax"))) / F.sum("v")
    return items(spark, sf_dir).groupBy("l_returnflag", "l_partkey").agg(F.round(value, 4).alias("composed"))


@query(f"""WITH p AS (SELECT {RGB}, l_quantity / 20 AS radius FROM lineitem) SELECT round(median(g) / median(r), 8) AS red, 1.0::DOUBLE AS green, round(median(g) / median(b), 8) AS blue FROM p WHERE radius BETWEEN 1.15 AND 1.6 AND r < 90000""")
def agg17_white_balance(spark, sf_dir):
    ring = colours(spark, sf_dir).where("radius between 1.15 and 1.6 and r < 90000")
    long = ring.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"])).alias("c")).select("c.*")
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("median")))
    return exact_median(long, ("channel",), "v").agg(F.round(at("g") / at("r"), 8).alias("red"), F.lit(1.0).alias("green"), F.round(at("g") / at("b"), 8).alias("blue"))


@query("""WITH f AS (SELECT l_suppkey, CASE WHEN l_discount > 0.01 THEN l_extendedprice END AS f, l_quantity AS w FROM lineitem) SELECT l_suppkey, round(sum(f * w) / sum(CASE WHEN f IS NOT NULL THEN w END), 4) AS mean FROM f GROUP BY 1""")
def agg21_mean_of_present(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("f", F.when(F.col("l_discount") > 0.01, F.col("l_extendedprice")))
    return d.groupBy("l_suppkey").agg(F.round(F.sum(F.col("f") * F.col("v")) / F.sum(F.when(F.col("f").isNotNull(), F.col("v"))), 4).alias("mean"))


@query("""WITH t AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) SELECT l_linenumber, count(*) AS n, round(median(l_extendedprice / 105000), 8) AS share FROM lineitem JOIN t ON l_suppkey = s_suppkey GROUP BY 1""")
def agg22_growth_of_brightest(spark, sf_dir):
    top = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("l_suppkey"))
    return items(spark, sf_dir).join(F.broadcast(top), "l_suppkey").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.median(F.col("l_extendedprice") / 105000), 8).alias("share"))


@query(f"""WITH w AS (SELECT {RING} AS bin, l_quantity AS x, 1 + l_tax * 10 AS var FROM lineitem) SELECT bin, round(sum(x / var) / sum(1 / var), 6) AS mean, round(sqrt(sum(1 / var / var * var)) / sum(1 / var), 8) AS error FROM w GROUP BY 1""")
def agg23_optimal_stack(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("var", 1 + F.col("l_tax") * 10).withColumn("w", 1 / F.col("var"))
    error = F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("var"))) / F.sum("w")
    return d.groupBy(F.col("ring").alias("bin")).agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 6).alias("mean"), F.round(error, 8).alias("error"))


@query("""WITH r AS (SELECT l_extendedprice / 10000 AS r, l_quantity AS v FROM lineitem), k AS (SELECT unnest([-1, 0, 1]) AS o)
SELECT CAST(floor(r) AS BIGINT) + o AS ring, count(*) AS n, median(v) AS mid FROM r, k WHERE abs(r - (floor(r) + o + 0.5)) <= 0.75 GROUP BY 1 HAVING count(*) > 500""")
def agg24_overlapping_rings(spark, sf_dir):
    r = items(spark, sf_dir).select((F.col("l_extendedprice") / 10000).alias("r"), "v", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("o")).withColumn("ring", F.floor("r") + F.col("o"))
    return r.where(F.abs(F.col("r") - (F.col("ring") + 0.5)) <= 0.75).groupBy("ring").agg(F.count("*").alias("n"), F.median("v").alias("mid")).where("n > 500")


@query(f"""WITH p AS (SELECT {RING} AS ring, l_quantity AS v FROM lineitem), m AS (SELECT ring, median(v) AS mid FROM p GROUP BY 1), s AS (SELECT ring, any_value(mid) AS mid, median(abs(v - mid)) AS mad FROM p JOIN m USING (ring) GROUP BY 1)
SELECT ring, mid, round(1.4826 * mad, 6) AS spread FROM s""")
def agg39_ring_median_and_spread(spark, sf_dir):
    return R.robust(items(spark, sf_dir), ["ring"], "v").select("ring", "mid", F.round(R.MAD * F.col("mad"), 6).alias("spread"))


@query("""WITH r AS (SELECT 1.2 + l_extendedprice / 10000 AS r, l_quantity AS v FROM lineitem) SELECT CAST(floor(round((r - 1.2) / 0.1, 6)) AS BIGINT) AS step, count(*) AS n, median(v) AS mid FROM r WHERE r < 12 GROUP BY 1 HAVING count(*) >= 500""")
def agg40_stepped_profile(spark, sf_dir):
    r = items(spark, sf_dir).withColumn("r", 1.2 + F.col("l_extendedprice") / 10000).where("r < 12")
    return r.groupBy(F.floor(F.round((F.col("r") - 1.2) / 0.1, 6)).alias("step")).agg(F.count("*").alias("n"), F.median("v").alias("mid")).where("n >= 500")


# Windows and sorts.


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS r, {RING} AS ring, l_quantity AS v FROM lineitem), m AS (SELECT ring, avg(v) AS c, stddev_pop(v) AS s FROM p GROUP BY 1 HAVING count(*) >= 30),
q AS (SELECT p.*, CAST(floor(r / 1000 - 0.5) AS BIGINT) AS lo, r / 1000 - 0.5 - floor(r / 1000 - 0.5) AS f FROM p),
b AS (SELECT q.*, coalesce((1 - f) * a.c + f * b.c, a.c, b.c) AS c, coalesce((1 - f) * a.s + f * b.s, a.s, b.s) AS s FROM q LEFT JOIN m a ON a.ring = lo LEFT JOIN m b ON b.ring = lo + 1)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s > 0 THEN (v - c) / s END, 6) AS residual FROM b""")
def win03_interpolated_rings(spark, sf_dir):
    d = items(spark, sf_dir)
    stats = d.groupBy("ring").agg(F.count("*").alias("n"), F.avg("v").alias("c"), F.stddev_pop("v").alias("s")).where("n >= 30")
    d = R.interpolated(d.drop("ring"), stats, "l_extendedprice", "c", width=1000.0).withColumnRenamed("trend", "c")
    d = R.interpolated(d, stats, "l_extendedprice", "s", width=1000.0).withColumnRenamed("trend", "s")
    return d.select("l_orderkey", "l_linenumber", F.round(F.when(F.col("s") > 0, (F.col("v") - F.col("c")) / F.col("s")), 6).alias("residual"))


@query(f"""WITH p AS (SELECT {RING} AS ring, count(*) AS n FROM lineitem GROUP BY 1) SELECT ring, n, CAST(sum(n) OVER (ORDER BY ring) - n AS BIGINT) AS first FROM p""")
def win15_group_offsets(spark, sf_dir):
    n = items(spark, sf_dir).groupBy("ring").agg(F.count("*").alias("n"))  # one row a ring
    return n.select("ring", "n", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("ring")) - F.col("n")).alias("first"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, (value > 10)::INT AS sat FROM events), m AS (SELECT *, (min(t) OVER (PARTITION BY user_id) + max(t) OVER (PARTITION BY user_id)) / 2.0 AS mid FROM e)
SELECT user_id, max(t) FILTER (t < mid AND sat > 0) AS before_last, min(t) FILTER (t < mid AND sat = 0) AS before_first, max(t) FILTER (t > mid AND sat = 0) AS after_last, min(t) FILTER (t > mid AND sat > 0) AS after_first FROM m GROUP BY 1""")
def win18_contacts(spark, sf_dir):
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") > 10).alias("sat"))
    e = e.withColumn("mid", (F.min("t").over(w) + F.max("t").over(w)) / F.lit(2.0))
    of = lambda f, when: f(F.when(F.expr(when), F.col("t")))
    return e.groupBy("user_id").agg(of(F.max, "t < mid and sat").alias("before_last"), of(F.min, "t < mid and not sat").alias("before_first"), of(F.max, "t > mid and not sat").alias("after_last"), of(F.min, "t > mid and sat").alias("after_first"))


@query("""SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer""")
def srt01_by_key(spark, sf_dir):
    return numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("""SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey, l_partkey, l_orderkey, l_linenumber) AS place FROM lineitem""")
def srt02_by_several_keys(spark, sf_dir):
    return numbered(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY abs(c_acctbal - 2500), c_custkey) AS place FROM customer""")
def srt03_by_size(spark, sf_dir):
    return numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.abs(F.col("c_acctbal") - 2500), "c_custkey")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 10""")
def srt05_ten_brightest(spark, sf_dir):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return items(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 10").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


# Stencils.


@query(f"""WITH g AS ({GRID}) SELECT y, x, value FROM g""")
def stn02_merged_planes(spark, sf_dir):
    planes = grid(spark, sf_dir).select((F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))).alias("plane"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "value")
    return G.merge_planes(planes)


GAUSS = "SELECT o, exp(-o * o / 2.0) AS k FROM (SELECT unnest(generate_series(-4, 4)) AS o)"
AROUND = f"g AS ({GRID}), k AS ({GAUSS}), s AS (SELECT g.y, g.x, any_value(g.value) AS value, sum(n.value * a.k * b.k) / sum(a.k * b.k) AS m, sum(n.value * n.value * a.k * b.k) / sum(a.k * b.k) AS q FROM g, k a, k b, g n WHERE n.x = g.x + a.o AND n.y = g.y + b.o GROUP BY 1, 2)"


@query(f"""WITH {AROUND} SELECT y, x, round(m, 6) AS smooth FROM s""")
def stn11_normalised_gauss(spark, sf_dir):
    return T.gauss(grid(spark, sf_dir), 1.0).withColumn("smooth", F.round("smooth", 6))


@query(f"""WITH {AROUND} SELECT y, x, round(sqrt(greatest(q - m * m, 0)), 5) AS spread FROM s""")
def stn12_local_spread(spark, sf_dir):
    return T.local_spread(grid(spark, sf_dir), 1.0).withColumn("spread", F.round("spread", 5))


@query(f"""WITH {AROUND} SELECT y, x, round(value - m, 6) AS fine FROM s""")
def stn33_fine_band(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.join(T.gauss(g, 1.0), ["y", "x"]).select("y", "x", F.round(F.col("value") - F.col("smooth"), 6).alias("fine"))


@query(f"""WITH {AROUND}, f AS (SELECT y, x, value - m AS f, floor(sqrt((x - 24.5) ** 2 + (y - 20.25) ** 2) / 4) AS ring FROM s), m AS (SELECT ring, median(f) AS mid, count(*) AS n FROM f GROUP BY 1)
SELECT CAST(f.ring AS BIGINT) AS ring, any_value(n) AS n, round(1.4826 * median(abs(f - mid)), 6) AS noise FROM f JOIN m ON f.ring = m.ring WHERE n >= 20 GROUP BY 1""")
def agg42_ring_noise(spark, sf_dir):
    g = grid(spark, sf_dir)
    fine = g.join(T.gauss(g, 1.0), ["y", "x"]).select(F.floor(P.distance(F.col("x"), F.col("y"), 24.5, 20.25) / 4).alias("ring"), (F.col("value") - F.col("smooth")).alias("fine"))
    return R.robust(fine, ["ring"], "fine", least=20).select("ring", "n", F.round(R.MAD * F.col("mad"), 6).alias("noise"))
