"""More named queries: photometry, catalogues, profiles and mosaics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import grid as G
from ..operators import match as M
from ..operators import rings as R
from ..operators.lineage import dealt
from ..operators.raster import b3, tile_map
from .catalogue import GRID, ORACLE, RING, grid, items, query, star_lists, table


def rounded(digits: int = 6, **columns):
    return [F.round(c, digits).alias(k) for k, c in columns.items()]


# Scalar functions.


@query("""SELECT p_partkey, round(((30 - p_size * 9.0) % 360 + 360) % 360, 6) AS angle, round(sin(radians(((30 - p_size * 9.0) % 360 + 360) % 360)), 6) AS dx, round(-cos(radians(((30 - p_size * 9.0) % 360 + 360) % 360)), 6) AS dy FROM part""")
def sca02_image_angle(spark, sf_dir):
    angle = S.image_angle(F.col("p_size") * 9.0, 30.0)
    to = S.direction(angle)
    return table(spark, sf_dir, "part").select("p_partkey", *rounded(angle=angle, dx=to["dx"], dy=to["dy"]))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN (l_extendedprice - 1000 * l_discount) / (20 * l_tax) END, 5) AS value, l_extendedprice >= 512 + 0.85 * (60000 - 512) AS saturated FROM lineitem""")
def sca13_calibrated(spark, sf_dir):
    raw = F.col("l_extendedprice")
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(S.calibrated(raw, 1000 * F.col("l_discount"), 20 * F.col("l_tax")), 5).alias("value"), S.saturated(raw, 60000.0, 512.0, 0.85).alias("saturated"))


TONE = "asinh(greatest({}, 0) / 30000 * 10) / asinh(10)"


@query(f"""WITH u AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS r, l_quantity * 1000 AS g, l_tax * 100000 AS b FROM lineitem),
a AS (SELECT *, {TONE.format('r')} AS ur, {TONE.format('g')} AS ug, {TONE.format('b')} AS ub FROM u),
p AS (SELECT *, greatest(ur, ug, ub) AS peak FROM a),
f AS (SELECT *, CASE WHEN peak > 0 THEN -0.9 * (exp(-peak / 0.9) - 1) / peak ELSE 0 END AS f FROM p)
SELECT l_orderkey, l_linenumber, round(0.25 * r + 0.5 * g + 0.25 * b, 4) AS luminance, round(ur * f, 6) AS r, round(ug * f, 6) AS g, round(ub * f, 6) AS b FROM f""")
def sca21_tone_map(spark, sf_dir):
    rgb = F.col("l_extendedprice"), F.col("v") * 1000, F.col("l_tax") * 100000
    r, g, b = S.tone_map(*rgb, scale=30000.0)
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", *rounded(4, luminance=S.luminance(*rgb)), *rounded(r=r, g=g, b=b))


@query("""SELECT p_partkey, round(pow(10, 0.4 * 0.12 * (p_size / 10.0 - 1.5)), 8) AS extinction,
round(1e6 * 1e-6 * (0.0532 * pow(greatest(p_size / 10.0, 1), -2.5) + 1.425 * pow(greatest(p_size / 10.0, 1), -7) + 2.565 * pow(greatest(p_size / 10.0, 1), -17)), 8) AS corona,
round(least(greatest((p_size - 20.0) / 12, 0), 1), 8) AS mask,
round(CASE WHEN p_retailprice - 1200 < 0 THEN ln(25.0 / (sqrt((p_retailprice - 1200) ** 2 / 4 + 25) - (p_retailprice - 1200) / 2)) ELSE ln((p_retailprice - 1200) / 2 + sqrt((p_retailprice - 1200) ** 2 / 4 + 25)) END, 6) AS soft,
round(CASE WHEN p_size < 25 THEN pow(2 * p_size / 50.0, 0.35) / 2 ELSE 1 - pow(2 - 2 * p_size / 50.0, 0.35) / 2 END, 8) AS upsilon,
round(pow(least(greatest((p_retailprice - 1000) / 800, 0), 1), 1 / 2.2), 8) AS stretched FROM part""")
def sca28_photometry(spark, sf_dir):
    x, price = F.col("p_size") / 10.0, F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", *rounded(8, extinction=S.extinction(x, 1.5, 0.12), corona=1e6 * S.baumbach(x), mask=S.soft_mask(F.col("p_size"), 20.0, 12.0)), *rounded(6, soft=S.soft_log(price - 1200, 5.0)),
        *rounded(8, upsilon=S.upsilon(F.col("p_size") / 50.0, 0.35), stretched=S.stretch(price, 1000.0, 1800.0, 2.2)),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 5 = 0 THEN '' ELSE concat_ws(', ', CASE WHEN p_size % 3 <> 0 THEN 'HIP ' || p_partkey ELSE 'TYC ' || concat_ws('-', p_size, p_partkey, 1) END,
CASE WHEN p_size % 2 = 0 THEN p_type END, 'V=' || replace(printf('%.2f', p_retailprice), '.', ',')) END AS label,
CASE WHEN p_size <= 20 THEN 'SEGUR' WHEN p_size <= 40 THEN 'POSSIBLE' ELSE 'FORA' END AS field, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS number, regexp_replace(p_name, '^[a-z]+ ?', '') AS tail FROM part""")
def sca39_labels(spark, sf_dir):
    size = F.col("p_size")
    tyc = F.when(size % 5 != 0, F.concat_ws("-", size, F.col("p_partkey"), F.lit("1")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.star_label(F.when(size % 3 != 0, F.col("p_partkey")), tyc, F.when(size % 2 == 0, F.col("p_type")), F.col("p_retailprice")).alias("label"),
        F.when(size <= 20, "SEGUR").when(size <= 40, "POSSIBLE").otherwise("FORA").alias("field"), F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("int").alias("number"),
        F.regexp_replace("p_name", "^[a-z]+ ?", "").alias("tail"),
    )


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 1000 END AS bt, 8 + c_nationkey / 10.0 AS vt, radians(c_custkey % 90 - 30) AS a, radians(c_nationkey * 2.0 - 20) AS d, radians(12.5) AS d0 FROM customer),
p AS (SELECT *, sin(d) * sin(d0) + cos(d) * cos(d0) * cos(a) AS den FROM c)
SELECT c_custkey, round(CASE WHEN bt IS NOT NULL THEN vt - 0.09 * (bt - vt) ELSE vt END, 8) AS v, round(0.85 * (bt - vt), 8) AS bv, round(degrees(cos(d) * sin(a) / den) * 3600, 3) AS xi,
round(degrees((sin(d) * cos(d0) - cos(d) * sin(d0) * cos(a)) / den) * 3600, 3) AS eta, round(degrees(acos(least(greatest(den, -1), 1))), 6) AS sep FROM p""")
def sca43_tangent_plane(spark, sf_dir):
    bt, vt = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 1000), 8 + F.col("c_nationkey") / 10.0
    to = S.tangent_plane(F.col("c_custkey") % 90, F.col("c_nationkey") * 2.0 - 20, 30.0, 12.5)
    return table(spark, sf_dir, "customer").select("c_custkey", *rounded(8, v=F.when(bt.isNotNull(), vt - 0.09 * (bt - vt)).otherwise(vt), bv=0.85 * (bt - vt)), *rounded(6, sep=to["sep"]), *rounded(3, xi=to["xi"], eta=to["eta"]))


@query("""SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 5000) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') AS middle, strftime(o_orderdate, '%Y:%m:%d') AS day FROM orders""")
def sca44_mid_instant(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz"))
    middle = F.col("t") + F.make_dt_interval(secs=(F.col("o_orderkey") % 5000).cast("decimal(18,6)")) - F.expr("INTERVAL 2 HOURS")
    return o.select("o_orderkey", F.date_format(middle, "yyyy-MM-dd'T'HH:mm:ss").alias("middle"), F.date_format("t", "yyyy:MM:dd").alias("day"))


@query("""SELECT l_orderkey, l_linenumber, flags, (flags & 5) <> 0 AS excluded FROM (SELECT l_orderkey, l_linenumber, CAST((l_quantity > 45)::INT | ((l_discount > 0.08)::INT * 2) | ((l_tax = 0)::INT * 4) AS INTEGER) AS flags FROM lineitem)""")
def sca45_bit_flags(spark, sf_dir):
    bit = lambda c, k: F.when(c, k).otherwise(0)
    flags = bit(F.col("v") > 45, 1).bitwiseOR(bit(F.col("l_discount") > 0.08, 2)).bitwiseOR(bit(F.col("l_tax") == 0, 4))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", flags.alias("flags"), (flags.bitwiseAND(F.lit(5)) != 0).alias("excluded"))


@query("""SELECT doc_id, sha256(text) AS digest FROM documents""")
def src24_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# Filters.


@query(f"""WITH p AS (SELECT {RING} AS ring, median(l_quantity) AS mid FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, ring, l_quantity AS v FROM (SELECT *, {RING} AS ring FROM lineitem) JOIN p USING (ring) WHERE l_quantity > 1.12 * mid""")
def fil03_excess_over_ring(spark, sf_dir):
    d = items(spark, sf_dir)
    return d.join(d.groupBy("ring").agg(F.median("v").alias("mid")), "ring").where(F.col("v") > 1.12 * F.col("mid")).select("l_orderkey", "l_linenumber", "ring", "v")


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1), d AS (SELECT l_suppkey, any_value(mid) AS mid, median(abs(l_extendedprice - mid)) AS mad FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1)
SELECT l_partkey, count(*) AS n, count(*) FILTER ((l_extendedprice - mid) / (1.4826 * mad) > 1) AS high, count(*) FILTER ((l_extendedprice - mid) / (1.4826 * mad) < -1) AS low FROM lineitem JOIN d USING (l_suppkey) WHERE mad > 0 GROUP BY 1""")
def fil04_persistent_outliers(spark, sf_dir):
    z = R.normalise(items(spark, sf_dir), ["l_suppkey"], "l_extendedprice", least=1).where("mad > 0")
    return z.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("residual") > 1).alias("high"), F.count_if(F.col("residual") < -1).alias("low"))


@query("""SELECT l_suppkey, count(*) AS n, round(avg((l_quantity >= 40)::INT), 6) AS share, round(avg(l_quantity) FILTER (l_quantity < 40), 6) AS mean FROM lineitem GROUP BY 1""")
def fil06_unsaturated_mean(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("n"), *rounded(share=F.avg((F.col("v") >= 40).cast("int")), mean=F.avg(F.when(F.col("v") < 40, F.col("v")))))


@query("""SELECT l_orderkey, l_linenumber, l_quantity >= 10 AND count(*) FILTER (l_quantity >= 10) OVER (PARTITION BY l_returnflag, l_partkey) >= 2 AS eligible FROM lineitem""")
def fil07_seen_twice(spark, sf_dir):
    usable = F.col("v") >= 10
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", (usable & (F.count_if(usable).over(Window.partitionBy("l_returnflag", "l_partkey")) >= 2)).alias("eligible"))


# Joins.


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def joi10_seen(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_nationkey")


@query("""WITH a AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_acctbal > 1500), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment < 'F')
SELECT coalesce(a.k, b.k) AS key, coalesce(a.v, b.v) AS v, a.k IS NOT NULL AND b.k IS NOT NULL AS both_have FROM a FULL JOIN b ON a.k = b.k""")
def joi11_fallback_merge(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 1500").select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("va"))
    b = table(spark, sf_dir, "customer").where("c_mktsegment < 'F'").select(F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("vb"))
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("key"), F.coalesce("va", "vb").alias("v"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_have"))


STARS = """a AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y, s_acctbal AS snr FROM supplier),
b AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
p AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM a, b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3)"""


@query(f"""WITH {STARS} SELECT a_id, b_id, CAST(k AS INTEGER) AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS k FROM p) WHERE k <= 3""")
def joi18_three_nearest(spark, sf_dir):
    return M.nearest(*star_lists(spark, sf_dir), 3.0, 3).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {STARS}, top AS (SELECT * FROM a ORDER BY snr DESC, id LIMIT 16)
SELECT CAST(floor((b.x - top.x) / 5) AS BIGINT) AS cx, CAST(floor((b.y - top.y) / 5) AS BIGINT) AS cy, count(*) AS votes FROM b, top WHERE abs(b.x - top.x) <= 40 AND abs(b.y - top.y) <= 40 GROUP BY 1, 2""")
def joi19_offset_votes(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.col("s_acctbal").alias("snr"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return M.vote(a, b, brightest=16, bin=5.0, reach=40.0)


@query("""SELECT l_suppkey, l_partkey, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_quantity, l_returnflag) AS k FROM lineitem) WHERE k = 1""")
def joi20_priority_dedupe(spark, sf_dir):
    priority = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return M.first_by(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], priority, "l_quantity", "l_returnflag").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag")


@query(f"""WITH {STARS} SELECT 'a' AS side, id FROM a WHERE id NOT IN (SELECT a_id FROM p) UNION ALL SELECT 'b', id FROM b WHERE id NOT IN (SELECT b_id FROM p)""")
def joi21_leftovers(spark, sf_dir):
    a, b = star_lists(spark, sf_dir)
    side = lambda name, rest: rest.select(F.lit(name).alias("side"), "id")
    return side("a", M.unmatched(a, b, 3.0)).unionByName(side("b", M.unmatched(b, a, 3.0)))


@query(f"""WITH p AS (SELECT {RING} AS ring, median(l_quantity) AS mid FROM lineitem GROUP BY 1),
d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 - 0.5 AS t, CAST(floor(l_extendedprice / 1000 - 0.5) AS BIGINT) AS lo FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce((1 - (t - lo)) * a.mid + (t - lo) * b.mid, a.mid, b.mid), 6) AS trend FROM d LEFT JOIN p a ON a.ring = lo LEFT JOIN p b ON b.ring = lo + 1""")
def joi22_interpolated_profile(spark, sf_dir):
    d = items(spark, sf_dir)
    profile = d.groupBy("ring").agg(F.median("v").alias("mid"))
    return R.interpolated(d, profile, "l_extendedprice", "mid", width=1000).select("l_orderkey", "l_linenumber", F.round("trend", 6).alias("trend"))


@query("""WITH m AS (SELECT user_id, max_by(event_id, value * 1e6 - event_id) AS peak FROM events GROUP BY 1)
SELECT user_id, peak, max(event_id) FILTER (event_id < peak AND value < 40) AS before, min(event_id) FILTER (event_id > peak AND value < 40) AS after FROM events JOIN m USING (user_id) GROUP BY 1, 2""")
def joi23_bracket(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.groupBy("user_id").agg(F.max_by("event_id", F.col("value") * 1e6 - F.col("event_id")).alias("peak"))
    side = lambda c: F.when(c & (F.col("value") < 40), F.col("event_id"))
    return e.join(m, "user_id").groupBy("user_id", "peak").agg(F.max(side(F.col("event_id") < F.col("peak"))).alias("before"), F.min(side(F.col("event_id") > F.col("peak"))).alias("after"))


@query("""SELECT n_nationkey AS key FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT * FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def set_operations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("key"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    return n.intersect(s).unionByName(n.subtract(c))


# Aggregates.


@query(f"""SELECT l_returnflag, {RING} AS ring, round(sum((1 - l_discount) ** 2 / (1 + l_quantity)), 6) AS weight, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2""")
def agg07_inverse_variance(spark, sf_dir):
    t = 1 - F.col("l_discount")
    return items(spark, sf_dir).groupBy("l_returnflag", "ring").agg(*rounded(weight=F.sum(t * t / (1 + F.col("v"))), mean=F.avg("v")))


@query("""SELECT l_suppkey, median(l_quantity) AS mid, round(stddev_pop(l_quantity), 6) AS sd, max_by(l_quantity, n * 1000 - l_quantity) AS mode
FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS n FROM lineitem) GROUP BY 1""")
def agg08_mode(spark, sf_dir):
    codes = items(spark, sf_dir).groupBy("l_suppkey", "v").agg(F.count("*").alias("n"))
    modes = codes.groupBy("l_suppkey").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))
    return items(spark, sf_dir).groupBy("l_suppkey").agg(F.median("v").alias("mid"), F.round(F.stddev_pop("v"), 6).alias("sd")).join(modes, "l_suppkey")


@query("""SELECT CAST(p_partkey // 400 AS BIGINT) AS y, CAST(p_partkey % 50 // 8 AS BIGINT) AS x, round(median(p_retailprice), 6) AS mid FROM part GROUP BY 1, 2""")
def agg18_block_median(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.groupBy(F.floor(F.col("y") / 8).alias("y"), F.floor(F.col("x") / 8).alias("x")).agg(F.round(F.median("value"), 6).alias("mid"))


@query(f"""WITH g AS ({GRID}) SELECT s.y * 50 + s.x AS star, count(*) AS n, round(sum(g.value) FILTER (sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) <= 1), 4) AS r1, round(sum(g.value) FILTER (sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) <= 2), 4) AS r2, round(sum(g.value), 4) AS r3
FROM g s JOIN g ON sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) <= 3 GROUP BY 1""")
def agg20_apertures(spark, sf_dir):
    # Each pixel is sent to the centres around it, where sums merge before the shuffle; a centre counts if it is a pixel itself.
    reach = range(-3, 4)
    offsets = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(np.hypot(i, j))).alias("d")) for i in reach for j in reach if np.hypot(i, j) <= 3]
    sent = grid(spark, sf_dir).where("y is not null and x is not null").select("*", F.explode(F.array(*offsets)).alias("o"))
    within = lambda r: F.sum(F.when(F.col("o.d") <= r, F.col("value")))
    at = sent.groupBy((F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).agg(F.count("*").alias("n"), within(1).alias("r1"), within(2).alias("r2"), F.sum("value").alias("r3"), F.count_if(F.col("o.d") == 0).alias("same"))
    same = F.col("same")  # pixels at one place are one star
    return at.where("same > 0").select((F.col("y") * 50 + F.col("x")).alias("star"), (F.col("n") * same).alias("n"), *rounded(4, **{r: F.col(r) * same for r in ("r1", "r2", "r3")}))


def apertures(pixels, *, radii=20, annulus=(26, 40), least=40):
    """Rows (star, n, background, f1 ...): every pixel of `pixels` (id, x, y, value), at whole x and y, as the centre of `radii` apertures.

    `background` is the median of the `n` pixels of the annulus and f_k the flux within k pixels above it; both are null where the
    annulus has fewer than `least` pixels. Tiles with a halo as wide as the annulus are measured by themselves.
    """
    reach = int(annulus[1])
    o = np.arange(-reach, reach + 1)
    far = np.hypot(o[:, None], o[None, :])
    dy, dx = (k - reach for k in np.nonzero(far <= reach))
    order = np.argsort(far[dy + reach, dx + reach], kind="stable")
    dy, dx = dy[order], dx[order]
    d = far[dy + reach, dx + reach]
    inner, ring = np.searchsorted(d, range(1, radii + 1), side="right"), (d >= annulus[0]) & (d < annulus[1])
    out = ("n", "background", *(f"f{k}" for k in range(1, radii + 1)))

    def measured(v, *_):
        made = {c: np.full(v.shape, np.nan) for c in out}
        y, x = np.nonzero(np.isfinite(v))
        inside = (y >= reach) & (y < v.shape[0] - reach) & (x >= reach) & (x < v.shape[1] - reach)
        for some in np.array_split(np.nonzero(inside)[0], 1 + inside.sum() // 256):
            at = y[some], x[some]
            near = v[at[0][:, None] + dy, at[1][:, None] + dx]
            outer = np.sort(near[:, ring], axis=1)  # what is missing comes last
            n = np.isfinite(outer).sum(axis=1)
            middle = (outer[np.arange(len(n)), np.maximum(n - 1, 0) // 2] + outer[np.arange(len(n)), np.minimum(n // 2, outer.shape[1] - 1)]) / 2
            back = np.where(n >= least, middle, np.nan)
            there = np.isfinite(near[:, : inner[-1]])
            total, count = np.cumsum(np.where(there, near[:, : inner[-1]], 0), axis=1), np.cumsum(there, axis=1)
            made["n"][at], made["background"][at] = n, back
            for k, end in enumerate(inner):
                made[f"f{k + 1}"][at] = total[:, end - 1] - back * count[:, end - 1]
        return made

    f = tile_map(pixels, measured, halo=reach, out=out, size=64).withColumn("n", F.col("n").cast("long"))
    star = pixels.select(F.col("id").alias("star"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return f.join(star, ["y", "x"]).select("star", "n", *rounded(4, **{c: F.col(c) for c in out[1:]}))


FLUXES = [(f"count(*) FILTER (d <= {k}) AS n{k}, sum(v) FILTER (d <= {k}) AS s{k}", f"round(s{k} - b * n{k}, 4) AS f{k}") for k in range(1, 21)]


@query(f"""WITH g AS ({GRID}), p AS (SELECT s.y * 50 + s.x AS star, sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) AS d, CAST(g.value AS DOUBLE) AS v FROM g s JOIN g ON sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) <= 40),
a AS (SELECT star, count(*) FILTER (d >= 26 AND d < 40) AS n, CASE WHEN count(*) FILTER (d >= 26 AND d < 40) >= 40 THEN median(v) FILTER (d >= 26 AND d < 40) END AS b, {", ".join(a for a, _ in FLUXES)} FROM p GROUP BY 1)
SELECT star, n, round(b, 4) AS background, {", ".join(f for _, f in FLUXES)} FROM a""")
def agg20_aperture_fluxes(spark, sf_dir):
    return apertures(grid(spark, sf_dir).withColumn("id", F.col("y") * 50 + F.col("x")))


@query(f"""WITH f AS ({ORACLE["agg20_aperture_fluxes"]}), t AS (SELECT * FROM f WHERE f20 > 0 ORDER BY f20 DESC, star LIMIT 10), k AS ({" UNION ALL ".join(f"SELECT {k} AS radius, f{k} / f20 AS share FROM t" for k in range(1, 21))})
SELECT radius, count(*) AS n, round(median(share), 6) AS growth FROM k GROUP BY 1""")
def agg22_curve_of_growth(spark, sf_dir):
    top = agg20_aperture_fluxes(spark, sf_dir).where("f20 > 0").orderBy(F.desc("f20"), "star").limit(10)
    shares = F.posexplode(F.array(*[F.col(f"f{k}") / F.col("f20") for k in range(1, 21)])).alias("k", "share")
    return top.select(shares).groupBy((F.col("k") + 1).alias("radius")).agg(F.count("*").alias("n"), F.round(F.median("share"), 6).alias("growth"))


@query("""WITH h AS (SELECT p_size // 5 AS cx, CAST(floor(p_retailprice / 100) AS BIGINT) AS cy, count(*) AS n FROM part GROUP BY 1, 2)
SELECT CAST(cx + i AS BIGINT) AS cx, cy + j AS cy, CAST(sum(n) AS BIGINT) AS votes FROM h, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY 1, 2""")
def agg25_smoothed_votes(spark, sf_dir):
    h = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_retailprice") / 100).alias("y"), F.floor(F.col("p_size") / 5).alias("x")).agg(F.count("*").alias("value"))
    return G.around(h, [(0, 0), (0, 1), (1, 0), (1, 1)]).groupBy(F.col("x").alias("cx"), F.col("y").alias("cy")).agg(F.sum("value").alias("votes"))


SUBSETS = "s AS (SELECT 'all' AS label, l_quantity AS v, l_tax FROM lineitem UNION ALL SELECT 'cheap', l_quantity, l_tax FROM lineitem WHERE l_extendedprice < 20000 UNION ALL SELECT 'full', l_quantity, l_tax FROM lineitem WHERE l_discount = 0)"


@query(f"""WITH {SUBSETS}, m AS (SELECT label, median(v) AS mid FROM s GROUP BY 1)
SELECT label, count(*) AS n, any_value(mid) AS mid, round(stddev_samp(v), 6) AS sd, round(1.4826 * median(abs(v - mid)), 6) AS mad, round(quantile_cont(v, 0.68), 6) AS p68, round(avg((v < 10)::INT), 6) AS within FROM s JOIN m USING (label) GROUP BY 1""")
def agg28_subsets(spark, sf_dir):
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("l_extendedprice") < 20000, "cheap"), F.when(F.col("l_discount") == 0, "full")))
    s = items(spark, sf_dir).select("v", F.explode(labels).alias("label"))
    more = s.groupBy("label").agg(*rounded(sd=F.stddev_samp("v"), p68=F.percentile("v", F.lit(0.68)), within=F.avg((F.col("v") < 10).cast("int"))))
    return R.robust(s, ["label"], "v").join(more, "label").select("label", "n", "mid", "sd", F.round(R.MAD * F.col("mad"), 6).alias("mad"), "p68", "within")


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_tax = 0) AS untaxed FROM lineitem GROUP BY 1""")
def agg29_distinct(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_tax") == 0).alias("untaxed"))


@query("""WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1), d AS (SELECT l_suppkey, l_quantity - mx AS x, l_extendedprice - my AS y FROM lineitem JOIN m USING (l_returnflag)),
f AS (SELECT sum(x * y) / sum(x * x) AS slope, sum(x * x) AS info FROM d), s AS (SELECT sum(x * (y - slope * x)) AS score FROM d, f GROUP BY l_suppkey)
SELECT round(any_value(slope), 4) AS slope, round(sqrt(sum(score * score)) / any_value(info), 4) AS error FROM s, f""")
def agg30_combined_fit(spark, sf_dir):
    d = items(spark, sf_dir)
    m = d.groupBy("l_returnflag").agg(F.avg("v").alias("mx"), F.avg("l_extendedprice").alias("my"))
    d = d.join(m, "l_returnflag").select("l_suppkey", (F.col("v") - F.col("mx")).alias("x"), (F.col("l_extendedprice") - F.col("my")).alias("y"))
    parts = d.groupBy("l_suppkey").agg(F.sum(F.col("x") * F.col("y")).alias("b"), F.sum(F.col("x") * F.col("x")).alias("i"))
    whole = parts.agg((F.sum("b") / F.sum("i")).alias("slope"), F.sum("i").alias("info"), F.lit(1).alias("one"))
    score = F.col("b") - F.col("slope") * F.col("i")
    return parts.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").agg(F.round(F.max("slope"), 4).alias("slope"), F.round(F.sqrt(F.sum(score * score)) / F.max("info"), 4).alias("error"))


@query("""SELECT l_suppkey, round(((SELECT sum(l_quantity) FROM lineitem) - sum(l_quantity)) / ((SELECT count(*) FROM lineitem) - count(*)), 6) AS mean FROM lineitem GROUP BY 1""")
def agg31_leave_one_out(spark, sf_dir):
    own = items(spark, sf_dir).groupBy("l_suppkey").agg(F.sum("v").alias("s"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    whole = own.agg(F.sum("s").alias("all"), F.sum("n").alias("rows"), F.lit(1).alias("one"))
    return own.join(F.broadcast(whole), "one").select("l_suppkey", F.round((F.col("all") - F.col("s")) / (F.col("rows") - F.col("n")), 6).alias("mean"))


CLIPPED = """f{k} AS (SELECT l_suppkey, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM d{k} GROUP BY 1),
r{k} AS (SELECT l_suppkey, y, x, y - slope * x - base AS res FROM d{k} JOIN f{k} USING (l_suppkey)), m{k} AS (SELECT l_suppkey, median(res) AS mid FROM r{k} GROUP BY 1),
a{k} AS (SELECT l_suppkey, any_value(mid) AS mid, median(abs(res - mid)) AS mad FROM r{k} JOIN m{k} USING (l_suppkey) GROUP BY 1),
d{n} AS (SELECT l_suppkey, y, x FROM r{k} JOIN a{k} USING (l_suppkey) WHERE abs(res - mid) <= 2 * 1.4826 * mad)"""


@query(f"""WITH d0 AS (SELECT l_suppkey, l_extendedprice AS y, l_quantity AS x FROM lineitem), {CLIPPED.format(k=0, n=1)}, {CLIPPED.format(k=1, n=2)}
SELECT l_suppkey, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS base FROM d2 GROUP BY 1""")
def agg35_clipped_fit(spark, sf_dir):
    return R.clipped_fit(items(spark, sf_dir), ["l_suppkey"], "l_extendedprice", "v", clip=2.0, rounds=2).select("l_suppkey", "n", *rounded(4, slope=F.col("slope"), base=F.col("base")))


@query("""WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT l_suppkey, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def agg37_spearman(spark, sf_dir):
    rank = lambda c: F.rank().over(Window.partitionBy("l_suppkey").orderBy(c)) + (F.count("*").over(Window.partitionBy("l_suppkey", c)) - 1) / 2.0
    return dealt(items(spark, sf_dir), "l_suppkey").select("l_suppkey", rank("v").alias("a"), rank("l_extendedprice").alias("b")).groupBy("l_suppkey").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query(f"""WITH m AS (SELECT {RING} AS ring, median(l_quantity / 50) AS mid, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 20)
SELECT ring AS worst, round(abs(mid - 0.5), 6) AS most FROM m ORDER BY abs(mid - 0.5) DESC, ring LIMIT 1""")
def agg41_largest_deviation(spark, sf_dir):
    m = items(spark, sf_dir).groupBy("ring").agg(F.median(F.col("v") / 50).alias("mid"), F.count("*").alias("n")).where("n >= 20")
    worst = F.max(F.struct(F.abs(F.col("mid") - 0.5).alias("d"), (-F.col("ring")).alias("r")))
    return m.agg(worst.alias("w")).where("w is not null").select((-F.col("w.r")).alias("worst"), F.round("w.d", 6).alias("most"))


@query(f"""WITH g AS (SELECT l_returnflag, {RING} AS ring, avg((l_quantity < 48)::INT) >= 0.85 AS good FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY l_returnflag ORDER BY ring RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM g)
SELECT l_returnflag, min(ring) AS ring FROM r WHERE run = 3 GROUP BY 1""")
def agg43_usable_from(spark, sf_dir):
    g = items(spark, sf_dir).groupBy("l_returnflag", "ring").agg((F.avg((F.col("v") < 48).cast("int")) >= 0.85).alias("good"))
    run = F.count_if("good").over(Window.partitionBy("l_returnflag").orderBy("ring").rangeBetween(0, 2))
    return g.withColumn("run", run).where("run = 3").groupBy("l_returnflag").agg(F.min("ring").alias("ring"))


@query(f"""WITH g AS ({GRID}), d AS (SELECT y, value - lag(value) OVER (PARTITION BY y ORDER BY x) AS d FROM g), m AS (SELECT y, median(d) AS mid FROM d GROUP BY 1)
SELECT y, round(1.4826 * median(abs(d - mid)) / sqrt(2), 6) AS sigma FROM d JOIN m USING (y) GROUP BY 1""")
def agg46_neighbour_noise(spark, sf_dir):
    d = grid(spark, sf_dir).select("y", (F.col("value") - F.lag("value").over(Window.partitionBy("y").orderBy("x"))).alias("d"))
    return R.robust(d, ["y"], "d", least=0).select("y", F.round(R.MAD * F.col("mad") / 2**0.5, 6).alias("sigma"))


# Windows.

NODES = "WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS ring, l_quantity AS v, (l_orderkey * 7) % 360 / 30.0 AS t FROM lineitem), e AS (SELECT *, CAST(floor(t) AS INTEGER) AS node, 1 - (t - floor(t)) AS w FROM d UNION ALL SELECT *, CAST((floor(t) + 1) AS INTEGER) % 12, t - floor(t) FROM d)"


@query(f"""{NODES}, r AS (SELECT *, ((rank() OVER k - 1) + cume_dist() OVER k * count(*) OVER (PARTITION BY ring, node)) / (2.0 * count(*) OVER (PARTITION BY ring, node)) AS q FROM e WINDOW k AS (PARTITION BY ring, node ORDER BY v))
SELECT l_orderkey, l_linenumber, l_partkey, ring, v, round(sum(w * q) / sum(w), 6) AS blended FROM r GROUP BY 1, 2, 3, 4, 5""")
def win09_sector_rank(spark, sf_dir):
    t = F.pmod(F.col("l_orderkey") * 7, F.lit(360)) / 30.0
    node = F.floor("t").cast("int")
    nodes = F.explode(F.array(F.struct(node.alias("node"), (1 - (F.col("t") - node)).alias("w")), F.struct(F.pmod(node + 1, F.lit(12)).alias("node"), (F.col("t") - node).alias("w"))))
    d = items(spark, sf_dir).withColumn("ring", F.floor(F.col("l_extendedprice") / 10000)).withColumn("t", t).withColumn("e", nodes)
    sector = Window.partitionBy("ring", "e.node")
    k, n = sector.orderBy("v"), F.count("*").over(sector)
    d = d.withColumn("q", (F.rank().over(k) - 1 + F.cume_dist().over(k) * n) / (2.0 * n))
    return d.groupBy("l_orderkey", "l_linenumber", "l_partkey", "ring", "v").agg(F.round(F.sum(F.col("e.w") * F.col("q")) / F.sum("e.w"), 6).alias("blended"))


@query("""WITH b AS (SELECT l_returnflag, l_orderkey % 36 AS sector, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_returnflag, (sector + o + 36) % 36 AS sector, median(v) AS running FROM b, range(-3, 4) t(o) GROUP BY 1, 2)
SELECT l_returnflag, sector, round(v / running, 6) AS ratio FROM b JOIN m USING (l_returnflag, sector)""")
def win11_circular_median(spark, sf_dir):
    b = items(spark, sf_dir).groupBy("l_returnflag", "sector").agg(F.avg("v").alias("v"))
    m = R.running_median(b, ["l_returnflag"], "sector", "v", bins=36, reach=3)
    return b.join(m, ["l_returnflag", "sector"]).select("l_returnflag", "sector", F.round(F.col("v") / F.col("running"), 6).alias("ratio"))


@query(f"""WITH p AS (SELECT l_returnflag, {RING} AS ring, median(l_quantity) AS mid FROM lineitem GROUP BY 1, 2), c AS (SELECT *, avg(mid) OVER (PARTITION BY ring) AS even FROM p)
SELECT l_orderkey, l_linenumber, round(l_quantity - mid + even, 6) AS v FROM (SELECT *, {RING} AS ring FROM lineitem) JOIN c USING (l_returnflag, ring)""")
def win14_even_rim(spark, sf_dir):
    d = items(spark, sf_dir)
    p = d.groupBy("l_returnflag", "ring").agg(F.median("v").alias("mid")).withColumn("even", F.avg("mid").over(Window.partitionBy("ring")))
    return d.join(p, ["l_returnflag", "ring"]).select("l_orderkey", "l_linenumber", F.round(F.col("v") - F.col("mid") + F.col("even"), 6).alias("v"))


@query(f"""WITH p AS (SELECT l_returnflag, {RING} AS ring, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, ring, round(max(v) OVER (PARTITION BY l_returnflag ORDER BY ring) - v, 6) AS dip, coalesce(lead(v) OVER (PARTITION BY l_returnflag ORDER BY ring) - v > 0.005, false) AS rises FROM p""")
def win17_running_dip(spark, sf_dir):
    p = items(spark, sf_dir).groupBy("l_returnflag", "ring").agg(F.avg("v").alias("v"))
    w = Window.partitionBy("l_returnflag").orderBy("ring")
    return p.select("l_returnflag", "ring", F.round(F.max("v").over(w) - F.col("v"), 6).alias("dip"), F.coalesce(F.lead("v").over(w) - F.col("v") > 0.005, F.lit(False)).alias("rises"))


@query("""SELECT event_id, user_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since FROM events""")
def win20_since_first(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", (t - F.min(t).over(Window.partitionBy("user_id"))).alias("since"))


# Sorting, stencils, composition.


@query(f"""WITH g AS ({GRID}), t AS (SELECT s.y, s.x, s.value, max(n.value) AS top FROM g s JOIN g n ON abs(n.y - s.y) <= 1 AND abs(n.x - s.x) <= 1 GROUP BY 1, 2, 3) SELECT y, x, value FROM t WHERE value = top AND value > 950""")
def srt08_local_maxima(spark, sf_dir):
    return G.local_maxima(grid(spark, sf_dir), 950.0)


@query(f"""WITH g AS ({GRID}) SELECT CAST(y % 2 * 2 + x % 2 AS INTEGER) AS plane, y // 2 AS y, x // 2 AS x, value FROM g""")
def stn01_split_planes(spark, sf_dir):
    half = lambda c: F.floor(F.col(c) / 2).alias(c)
    return grid(spark, sf_dir).select((F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))).cast("int").alias("plane"), half("y"), half("x"), "value")


@query(f"""WITH g AS ({GRID}), m AS (SELECT s.y, s.x, avg(n.value) AS v, count(*) AS n FROM g s JOIN g n ON abs(n.y - s.y) + abs(n.x - s.x) = 1 GROUP BY 1, 2)
SELECT g.y, g.x, round(CASE WHEN (g.y + g.x) % 2 = 1 THEN value WHEN n = 4 THEN v END, 6) AS green FROM g LEFT JOIN m USING (y, x)""")
def stn03_green_plane(spark, sf_dir):
    return G.green_plane(grid(spark, sf_dir)).withColumn("green", F.round("green", 6))


@query(f"""WITH g AS ({GRID}), k(o, k) AS (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)),
s AS (SELECT g.y, g.x, any_value(g.value) AS value, sum(n.value * a.k * b.k) / sum(a.k * b.k) AS smooth FROM g, k a, k b, g n WHERE n.x = g.x + a.o AND n.y = g.y + b.o GROUP BY 1, 2) SELECT y, x, round(value - smooth, 6) AS detail FROM s""")
def stn13_high_pass(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.join(b3(g), ["y", "x"]).select("y", "x", F.round(F.col("value") - F.col("smooth"), 6).alias("detail"))


@query("""WITH b AS (SELECT p_partkey, p_retailprice / 2500 AS b, p_size / 50.0 AS l FROM part), m AS (SELECT *, b + (b * l - b) * 0.5 AS c FROM b)
SELECT p_partkey, round(c + ((CASE WHEN c < 0.5 THEN 2 * c * l ELSE 1 - 2 * (1 - c) * (1 - l) END) - c) * 0.8, 8) AS blended FROM m""")
def stn57_layers(spark, sf_dir):
    layer = F.col("p_size") / 50.0
    base = S.blend(F.col("p_retailprice") / 2500, layer, "multiply", 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.blend(base, layer, "overlay", 0.8), 8).alias("blended"))
