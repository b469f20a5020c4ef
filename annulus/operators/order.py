"""Rows numbered in a global order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, *keys: str | Column, name: str = "place") -> DataFrame:
    """`df` with the place, from 1, of each row in the order of `keys`, which must end in something unique.

    Rows are dealt by ranges of the keys and sorted inside them; a row's place is its place in its range after the sizes of the ranges
    before it, a table with a row for each range.
    """
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    d = cut(d.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    sizes = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
