"""Exact quantiles of groups of any size: ranks are narrowed down by counts of ranges, and no group comes together in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import FEW, cut, few


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], value: str, probs: tuple[float, ...], *, buckets: int = 1024) -> DataFrame:
    """Rows (*keys, n, prob, quantile): quantiles of the values present, linear between neighbouring ranks.

    A quantile lies between two ranks. Of each rank only the range is known that holds it, at first that of the smallest and the largest value;
    a round counts the range's rows in `buckets` parts, each with its smallest and largest value, and goes on with the part that holds the
    rank, until that has a single value. Each round reads the slim table of keys and values once and shuffles a count per task, rank and part.
    Keys that are null form a group; groups without values give no rows.
    """
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    v = F.col(value).cast("double")
    d = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    at = F.col("prob") * (F.col("n") - 1)
    targets = ends.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).select("*", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    open_ = cut(targets.select(*keys, "n", "prob", "rank", F.col("rank").alias("left"), "lo", "hi"))
    done = open_.where("lo = hi")
    open_ = open_.where("lo < hi")
    which = [*keys, "n", "prob", "rank"]
    while n_open := open_.count():
        asked = open_.select(*which, "left", "lo", "hi")
        asked = (F.broadcast(asked) if n_open <= FEW else asked).alias("t")
        d_ = d.alias("d")
        inside = F.col("v").between(F.col("lo"), F.col("hi"))
        # Without keys there are at most two ranks for each of `probs`; with keys they are counted.
        both = d_.join(asked, on("d", "t"), "inner").where(inside) if keys else d_.join(asked, inside)
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        named = [F.col(f"t.{c}").alias(c) for c in (*which, "left")]
        counts = both.select(*named, part.alias("part"), "v").groupBy(*which, "left", "part").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*which).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))
        found = cut(found.select(*which, (F.col("left") - F.col("before")).alias("left"), "lo", "hi"))
        done, open_ = done.unionByName(found.where("lo = hi")), found.where("lo < hi")
    f = F.col("prob") * (F.col("n") - 1) - F.floor(F.col("prob") * (F.col("n") - 1))
    low, high = F.min_by("lo", "rank"), F.max_by("lo", "rank")
    return done.groupBy(*keys, "n", "prob").agg(low.alias("a"), high.alias("b")).select(*keys, "n", "prob", (F.col("a") + (F.col("b") - F.col("a")) * f).alias("quantile"))


def exact_median(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Rows (*keys, n, median) by `exact_quantiles`."""
    return exact_quantiles(df, keys, value, (0.5,)).select(*keys, "n", F.col("quantile").alias("median"))


def bracketed_median(df: DataFrame, keys: tuple[str, ...], value: str, *, reach: float = 5e-4, accuracy: int = 20_000) -> DataFrame:
    """Rows (*keys, n, median), exact, from two passes over `df`, whatever its size; rows whose key is null give none.

    A quantile sketch brackets the middle of each group, `reach` of its rows to either side; the second pass counts the values below the bracket and each value inside it.
    A group whose middle is not inside, which the sketch's error does not allow, is left to `exact_median`.
    """
    v = F.col(value).cast("double")
    d = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = F.percentile_approx("v", [0.5 - reach, 0.5 + reach], accuracy)
    ends = few(d.groupBy(*keys).agg(F.count("*").alias("n"), ends.alias("ends")).where("n > 0").select(*keys, "n", F.col("ends")[0].alias("lo"), F.col("ends")[1].alias("hi")))
    rows = (d.join(ends, list(keys)) if keys else d.join(F.broadcast(ends), F.lit(True))).where("v <= hi")
    counts = rows.groupBy(*keys, "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    reached = lambda rank: F.min(F.when(F.col("upto") > F.expr(rank), F.col("v")))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
    found = counts.withColumn("upto", upto).groupBy(*keys, "n").agg(reached("(n - 1) div 2").alias("a"), reached("n div 2").alias("b"), below.alias("below"))
    found = cut(found.withColumn("inside", (F.col("below") <= F.expr("(n - 1) div 2")) & F.col("b").isNotNull()))
    medians = found.where("inside").select(*keys, "n", (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))
    missed = found.where("not inside")
    if missed.isEmpty():
        return medians
    left = df.join(missed.select(*keys), list(keys), "left_semi") if keys else df
    return medians.unionByName(exact_median(left, keys, value))
