"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut


def words_of(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Target of each source from (source, source_size): shares by weight, none above `most` times its size.

    Weights repeat over the sources in code-point order, null last. What a stopped source leaves is shared
    again by weight; the fixed point is target = min(cap, level * weight), and the level is read off the
    sources ordered by cap / weight. The table has one row per source.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    stopped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    t = t.withColumn("level", (total - stopped) / free)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    return t.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def shares(sizes: DataFrame, most: int) -> DataFrame:
    """Per source and size the numbers that sampling needs, from (source, size, n, source_size, target).

    whole copies are certain; want is what they leave of the target; pi, the inclusion probability of a document, is in proportion to its size
    and 1 at most, such that the expected words are want. Sizes from which on it is 1 are found from the largest down.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    t = sizes.withColumn("expected", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
    t = t.withColumn("whole", F.floor("expected").cast("long")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    t = t.withColumn("words", (F.col("n") * F.col("size")).cast("decimal(38,0)")).withColumn("square", (F.col("words") * F.col("size")).cast("decimal(38,0)"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    below = F.sum("square").over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    t = t.withColumn("rate", F.when(below > 0, (F.col("want") - above) / below))
    rate = F.max(F.when(F.col("rate") * F.col("size") <= 1, F.struct("size", "rate"))).over(Window.partitionBy("source"))["rate"]
    return t.select("source", "size", "source_size", "target", "whole", "want", F.least(F.lit(1.0), F.coalesce(rate, F.lit(0.0)) * F.col("size")).alias("pi"))


def mix(docs: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, carry: tuple[str, ...] = (), rounds: int = 3) -> DataFrame:
    """How many copies of each document the mix takes: rows (id, source, *carry, nth, size, source_size, target, copies).

    A source needs target / size copies of each word: the whole part is certain, and for the rest a document's inclusion probability is in
    proportion to its size (`shares`). Documents are ranked by random odds over
    inclusion odds (Pareto order sampling; the random number comes from a digest of id and source, so reruns
    agree), those with probability 1 first, and taken in order while the words fit. In `rounds` - 1 more rounds the same is done with the
    documents left that are no longer than the words missing. The last place goes to the one row still out whose size
    comes nearest to the words missing, if that is nearer than leaving it empty; so it is not random.

    The order within a source is a sum over slices of the rank first and a window inside
    one slice second; slices hold some thousand rows each at any size of the table, so a source that holds most rows is spread over tasks. Null or empty texts have size 0
    and are never taken; rows that repeat an id share a random number but are taken one by one, and `nth` numbers rows that are equal in all
    columns read; an empty table gives none. Columns other than those named are not read.
    """
    d = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    row = ["source", "id", "size", *[f"carry_{c}" for c in carry]]
    d = cut(d.withColumn("nth", F.row_number().over(Window.partitionBy(*row).orderBy(F.lit(0)))))  # each text is read once
    fine = F.lit(float(d.count() // 50_000 + 1))
    sizes = d.groupBy("source", "size").agg(F.count("*").alias("n"))
    # One row per source: a join that broadcasts by Spark's own size check.
    per = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    per = shares(sizes.alias("d").join(per.alias("p"), same("d", "p")).select("d.source", "size", "n", "source_size", "target"), most)
    d = d.alias("d").join(per.alias("p"), same("d", "p") & (F.col("d.size") == F.col("p.size"))).select("d.*", "source_size", "target", "whole", "want", "pi")
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("source", F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    odds = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    d = d.withColumn("rank", F.when(F.col("pi") >= 1, u - 1).when(F.col("pi") > 0, odds)).withColumn("taken", F.lit(False))
    d = d.withColumn("slice", F.floor(F.when(F.col("rank") < 0, F.col("rank") * fine * 8 - 1e12).otherwise(F.log("rank") * fine)))
    for _ in range(rounds):
        d = cut(fill(d, same, row))
    left = missing(d)
    out = d.where("rank is not null and not taken").alias("d").join(left.alias("m"), same("d", "m"))
    place = F.struct(F.abs(F.col("missing") - F.col("size")).alias("off"), "rank", "id", "size", *row[3:], "nth")
    best = out.groupBy("d.source").agg(F.min(place).alias("b"), F.first("missing").alias("missing")).where("b.off < abs(missing)").select("source", "b.*")
    last = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*row, "nth"]]
    d = d.alias("d").join(best.withColumn("last", F.lit(True)).alias("b"), reduce(Column.__and__, last), "left").select("d.*", "last")
    copies = F.col("whole") + (F.col("taken") | F.coalesce("last", F.lit(False))).cast("long")
    return d.select(F.col("id").alias(id), F.col("source").alias(source), *[F.col(f"carry_{c}").alias(c) for c in carry], "nth", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"))


def missing(d: DataFrame) -> DataFrame:
    """The words that each source still lacks."""
    return d.groupBy("source").agg((F.first("want") - F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0))).alias("missing"))


def fill(d: DataFrame, same, row: list[str]) -> DataFrame:
    """`d` with more rows taken: of those that are out and no longer than the words missing, in the order of rank, while they fit."""
    d = d.alias("d").join(missing(d).alias("m"), same("d", "m")).select("d.*", "missing")
    d = d.withColumn("open", F.col("rank").isNotNull() & ~F.col("taken") & (F.col("size") <= F.col("missing"))).withColumn("new", F.when(F.col("open"), F.col("size")).otherwise(0))
    slices = d.groupBy("source", "slice").agg(F.sum("new").alias("in_slice"))
    slices = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.alias("d").join(slices.alias("s"), same("d", "s") & F.col("d.slice").eqNullSafe(F.col("s.slice"))).select("d.*", "before")
    inside = Window.partitionBy("source", "slice").orderBy(F.col("rank").asc_nulls_last(), F.col("id").asc_nulls_last(), "size", *row[3:], "nth").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("open") & (F.col("before") + F.sum("new").over(inside) <= F.col("missing"))
    return d.withColumn("taken", F.col("taken") | fits).drop("missing", "open", "new", "before")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _round(k: int) -> str:
    return f"""
m{k} AS (SELECT source, any_value(want) - sum(CASE WHEN taken THEN size ELSE 0 END) AS missing FROM t{k} GROUP BY source),
o{k} AS (SELECT t{k}.*, missing, rank IS NOT NULL AND NOT taken AND size <= missing AS open FROM t{k} JOIN m{k} ON t{k}.source IS NOT DISTINCT FROM m{k}.source),
t{k + 1} AS (SELECT doc_id, source, size, source_size, target, whole, want, rank,
  taken OR (open AND sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) <= missing) AS taken FROM o{k}),"""


#: The same in SQL. The weights, the limit and the three rounds are those of the query.
OP5_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
g AS (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM g) * weight) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS expected FROM t),
q AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, target - floor(expected) * source_size AS want FROM p),
z AS (SELECT d.source, d.size, count(*) AS n, any_value(want) AS want FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source GROUP BY d.source, d.size),
y AS (SELECT *, (want - CAST(coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
              / nullif(CAST(sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS rate FROM z),
c AS (SELECT source, arg_max(rate, size) AS rate FROM y WHERE rate * size <= 1 GROUP BY source),
i AS (SELECT d.*, source_size, target, whole, want, least(1.0::DOUBLE, coalesce(rate, 0) * size) AS pi
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
t0 AS (SELECT doc_id, source, size, source_size, target, whole, want, CASE WHEN pi >= 1 THEN u - 1 WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS rank, false AS taken FROM i),"""
    + "".join(_round(k) for k in range(3))
    + """
m AS (SELECT source, any_value(want) - sum(CASE WHEN taken THEN size ELSE 0 END) AS missing FROM t3 GROUP BY source),
b AS (SELECT t3.source, doc_id, size, row_number() OVER (PARTITION BY t3.source ORDER BY abs(missing - size), rank, doc_id, size) AS n, abs(missing - size) < abs(missing) AS better
      FROM t3 JOIN m ON t3.source IS NOT DISTINCT FROM m.source WHERE rank IS NOT NULL AND NOT taken)
SELECT t3.doc_id, t3.size, t3.source_size, t3.target, CASE WHEN t3.size > 0 THEN t3.size * (whole + CASE WHEN taken OR b.doc_id IS NOT NULL THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM t3 LEFT JOIN b ON b.n = 1 AND b.better AND t3.source IS NOT DISTINCT FROM b.source AND t3.doc_id = b.doc_id
"""
)
