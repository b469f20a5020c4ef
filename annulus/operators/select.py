"""Greedy selections made in parallel: the strongest of close rows stay."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def suppressed(rows: DataFrame, radius: float) -> DataFrame:
    """The rows (id, x, y, strength) that stay when, strongest first, each that stays drops all others at most `radius` away.

    Ties in strength go to the smaller id; ids are unique; rows with a null or NaN position or strength never stay. The result is that of
    the loop over rows, made in rounds: a row that no open row within the radius beats stays and drops its neighbours, until no
    row is open. Cells are so small that two rows of a cell are always close, so of a cell only its strongest open row can stay
    next: a round compares one row of each cell with the open rows of the 24 cells around, which is linear in the rows however crowded a
    cell is. There are as many rounds as the longest chain of rows that wait for each other.
    """
    side = radius / math.sqrt(2) * (1 - 1e-12)
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("x", "y", "strength")]
    cell = lambda c: F.floor(F.col(c) / side)
    open_ = cut(rows.where(ok[0] & ok[1] & ok[2]).select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "strength")], cell("x").alias("cx"), cell("y").alias("cy")))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    near = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")) <= radius * radius
    beats = (F.col("strength") > F.col("ss")) | (F.col("strength") == F.col("ss")) & (F.col("id") < F.col("s"))

    def sent(some: DataFrame) -> DataFrame:
        """Rows (s, sx, sy, ss) beside the cells around them."""
        named = some.select(F.col("id").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("strength").alias("ss"), "cx", "cy", around.alias("o"))
        return named.select("s", "sx", "sy", "ss", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))

    kept = None
    while not open_.isEmpty():
        best = F.max(F.struct("strength", F.struct((-F.col("id")).alias("order")), "id", "x", "y")).alias("best")
        tops = open_.groupBy("cx", "cy").agg(best).select("best.id", "best.x", "best.y", "best.strength", "cx", "cy")
        beaten = sent(tops).join(open_, ["cx", "cy"]).where(near & beats).select("s").distinct()
        stay = cut(tops.join(beaten, F.col("id") == F.col("s"), "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = open_.join(sent(stay), ["cx", "cy"]).where(near).select("id").distinct()
        open_ = cut(open_.join(gone, "id", "left_anti"))
    return (kept if kept is not None else open_).select("id", "x", "y", "strength")
