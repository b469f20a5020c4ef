"""Named queries over text tables and recipes that Spark writes from the tables and reads again."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import recipes as C
from ..sources import text as X
from .catalogue import query, table
from .sky import rounded


def written(lines: DataFrame, before: tuple[str, ...] = ()) -> str:
    """A folder of text files with the lines (value), each file beginning with the lines `before`."""

    def head(batches):
        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(before, b.schema.field(0).type)], schema=b.schema)
            first = False
            yield b

    path = f"{shared_folder(lines.sparkSession)}/text-{uuid.uuid4().hex}"
    (lines.mapInArrow(head, "value string") if before else lines).write.text(path)
    return path


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


HEADER = ("#a deep catalogue", "", "_RAJ2000\t_DEJ2000\tTYC1\tTYC2\tTYC3\tBTmag\tVTmag\tpmRA\tpmDE\tHIP", "deg\tdeg\t\t\t\tmag\tmag\tmas/yr\tmas/yr\t", "---\t---\t---\t---\t---\t---\t---\t---\t---\t---", "#rows")


@query("""SELECT c_nationkey || '-' || c_custkey || '-1' AS tyc, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey::INTEGER END AS hip, c_acctbal / 50 AS ra, c_nationkey::DOUBLE AS dec, round(CASE WHEN c_acctbal > 500 THEN 9.0 - 0.09 * (c_acctbal / 1000 - 9.0) ELSE 9.0 END, 8) AS v,
round(CASE WHEN c_acctbal > 500 THEN 0.85 * (c_acctbal / 1000 - 9.0) END, 8) AS bv, c_acctbal / 100 AS pm_ra, 0.0::DOUBLE AS pm_dec FROM customer WHERE c_acctbal > -500 AND c_mktsegment <> 'MACHINERY'""")
def src10_located_header(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    full = [F.col("c_acctbal") / 50, F.col("c_nationkey"), F.col("c_nationkey"), F.col("c_custkey"), F.lit(1), F.when(F.col("c_acctbal") > 500, F.col("c_acctbal") / 1000), F.when(F.col("c_mktsegment") != "MACHINERY", F.lit(9.0)), F.col("c_acctbal") / 100, F.lit("~"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))]
    line = F.concat_ws("\t", *[shown(x) for x in full])
    ragged = F.concat_ws("\t", *[shown(x) for x in full[:7]])  # lines that end early
    path = written(c.select(F.when(F.col("c_acctbal") <= -500, ragged).otherwise(line).alias("value")), HEADER)
    rows, _ = X.located_table(spark, path, "_RAJ2000")
    d = X.tycho(rows)
    return d.select("tyc", "hip", "ra", "dec", *rounded(8, v=F.col("v"), bv=F.col("bv")), "pm_ra", "pm_dec")


@query("""SELECT count(*) AS bad FROM customer WHERE c_acctbal <= -500""")
def src10_bad_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    whole, short = "_RAJ2000\tVTmag", F.concat_ws("\t", shown(F.col("c_acctbal")), shown(F.col("c_custkey")))
    path = written(c.select(F.when(F.col("c_acctbal") <= -500, shown(F.col("c_acctbal"))).otherwise(short).alias("value")), ("#", whole, "deg\tmag", "---\t---"))
    return X.located_table(spark, path, "_RAJ2000")[1].agg(F.count("*").alias("bad"))


@query("""SELECT p_partkey::INTEGER AS hip, CASE WHEN p_size > 5 THEN p_retailprice / 200 END AS v, p_brand AS hd FROM part""")
def src11_fields_by_place(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat_ws("|", F.lit("H"), F.concat(F.lit("  "), shown(F.col("p_partkey"))), F.lit("x"), F.lit(""), F.lit(""), F.when(F.col("p_size") > 5, shown(F.col("p_retailprice") / 200)).otherwise("?"), shown(F.col("p_brand")), F.lit("end"))
    path = written(p.select(line.alias("value")), ("H|not a number|||||||", "#comment"))
    return X.positioned_table(spark, path, {"hip": (1, "int"), "v": (5, "double"), "hd": (6, "string")}, sep=r"\|", key="hip")[0]


@query("""SELECT 's' || s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier WHERE s_acctbal >= 0""")
def src12_detections(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    x = F.when(F.col("s_acctbal") >= 0, shown(F.col("s_acctbal"))).otherwise("nan?")
    path = written(s.select(F.concat(F.lit("  s"), shown(F.col("s_suppkey")), F.lit("   "), x, F.lit("\t"), shown(F.col("s_nationkey")), F.lit(" 7")).alias("value")), ("# id x y", " "))
    return X.positioned_table(spark, path, {"id": (0, "string"), "x": (1, "double"), "y": (2, "double")}, sep=r"\s+", required=("x", "y"))[0]


@query("""SELECT 'V' || CASE WHEN length(s_suppkey::VARCHAR) < 2 THEN '0' || s_suppkey ELSE s_suppkey::VARCHAR END AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y, s_acctbal * 2 AS flux, s_acctbal / 10 AS snr FROM supplier WHERE s_nationkey < 10""")
def src12_classes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_nationkey") < 5, "A").when(F.col("s_nationkey") < 10, "B").otherwise("C")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x_px"), F.col("s_nationkey").cast("double").alias("y_px"), (F.col("s_acctbal") * 2).alias("flux_G_ADUs"), (F.col("s_acctbal") / 10).alias("SNR_pila"), kind.alias("classe")).write.option("header", True).csv(path)
    rows = spark.read.schema("id long, x_px double, y_px double, flux_G_ADUs double, SNR_pila double, classe string").option("header", True).csv(path)
    return X.detections(rows).select("id", "x", "y", "flux", "snr")


@query("""SELECT s_suppkey, 1000 AS height, s_nationkey + 1 AS width, s_acctbal AS sun_x, s_acctbal / 2 AS sun_y, 50.5::DOUBLE AS radius, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS moon_x, s_acctbal > 5000 AS mirrored, CASE WHEN s_acctbal > 5000 THEN 12.5 ELSE 0 END AS north FROM supplier""")
def src06_geometry(spark, sf_dir):
    s, b = table(spark, sf_dir, "supplier"), F.col("s_acctbal")
    turned = F.when(b > 5000, F.lit(12.5))
    given = F.to_json(F.struct(F.array(F.lit(1000), F.col("s_nationkey") + 1).alias("shape"), F.array(b, b / 2).alias("sun_xy"), F.lit(50.5).alias("sun_radius_px"), F.when(b > 0, F.array(b, b)).alias("moon_xy"), turned.alias("north_deg"), F.when(b > 5000, True).alias("mirrored")))
    again = C.geometry(C.geometry_json(C.geometry(given)))
    g = s.select("s_suppkey", again.alias("g"))
    return g.select("s_suppkey", F.col("g.shape")[0].alias("height"), F.col("g.shape")[1].alias("width"), F.col("g.sun_xy")[0].alias("sun_x"), F.col("g.sun_xy")[1].alias("sun_y"), F.col("g.sun_radius_px").alias("radius"), F.col("g.moon_xy")[0].alias("moon_x"), F.col("g.mirrored").alias("mirrored"), F.col("g.north_deg").alias("north"))


@query("""SELECT c_mktsegment, count(*) AS inputs, sum(strlen(c_name))::BIGINT AS bytes, sha256(string_agg(c_custkey::VARCHAR || ' ' || sha256(c_name), chr(10) ORDER BY c_custkey::VARCHAR COLLATE "C", sha256(c_name))) AS sha256 FROM customer GROUP BY 1""")
def src23_input_digests(spark, sf_dir):
    return C.digests(table(spark, sf_dir, "customer"), ("c_mktsegment",), "c_custkey", "c_name")
