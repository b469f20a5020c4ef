"""Connected regions of pixels: labels inside tiles, united over the borders of tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .raster import TILE


def linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest of n nodes that each reaches over the pairs (a, b), by minima and pointer jumps."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def united(links: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node reachable over the links (a, b), for nodes with links.

    Each round every node tells its neighbours the smallest node it knows and jumps to what that one knows, so paths halve; rounds are
    checkpointed and stop when none changes.
    """
    e = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    low = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        told = e.join(low, e["b"] == low["node"]).groupBy("a").agg(F.min("root").alias("m"))
        near = low.join(told, low["node"] == told["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # A root that was told of a smaller one passes it on, and all that point to it follow.
        hooks = near.groupBy(F.col("old").alias("at")).agg(F.min("root").alias("up"))
        near = near.join(hooks, F.col("old") == F.col("at")).select("node", "old", F.least("root", "up").alias("root"))
        jump = near.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut(near.join(jump, F.col("root") == F.col("via"), "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        low = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return low


def labelled(mask: DataFrame, *, width: int, eight: bool = False, keys: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Rows (*keys, y, x, label) of the pixels (*keys, y, x) of a mask; label is the smallest y * width + x of the region.

    Regions join pixels that share a side, or with `eight` a corner. Each tile labels its own pixels by arrays; along borders, pixels of
    neighbouring tiles link their labels, and only those labels are united in rounds. `width` exceeds all x, which are at least 0.
    """
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]

    def label(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        place = np.full((size + 2, size + 2), -1, dtype=np.int64)
        order = np.lexsort((x, y))
        i, j = y[order] % size + 1, x[order] % size + 1
        place[i, j] = np.arange(len(order))
        pairs = [(np.nonzero(to >= 0)[0], to[to >= 0]) for to in (place[i + dy, j + dx] for dy, dx in steps)]
        low = linked(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(order))
        found = np.empty(len(order), dtype=np.int64)
        found[order] = (y[order] * width + x[order])[low]
        return pa.table([*(table.column(c) for c in (*keys, "y", "x")), pa.array(found)], names=[*keys, "y", "x", "label"])

    kinds = [f"`{c}` {mask.schema[c].dataType.simpleString()}" for c in keys]
    d = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct().withColumns({"ty": F.floor(F.col("y") / size), "tx": F.floor(F.col("x") / size)})
    d = cut(d.groupBy(*keys, "ty", "tx").applyInArrow(label, ", ".join([*kinds, "y long", "x long", "label long"])))
    own = F.struct(*keys, "label")
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    rim = lambda c: F.pmod(c, F.lit(size)).isin(0, size - 1)
    edge = d.where(rim("y") | rim("x")).withColumn("a", own)
    sent = edge.select(*keys, "a", near.alias("o"), "y", "x").select(*keys, F.col("a").alias("b"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    roots = united(edge.join(sent, [*keys, "y", "x"]).select("a", "b")).select(F.col("node").alias("a"), F.col("root.label").alias("root"))
    return d.withColumn("a", own).join(roots, "a", "left").select(*keys, "y", "x", F.coalesce("root", "label").alias("label"))


def regions(pixels: DataFrame, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, label, area, y, x, h, w, roundness, filling, peak) of labelled pixels (*keys, y, x, label, value).

    y and x are the mean position, h and w the sides of the box, roundness the short side over the long one, filling the area over the box, peak the
    largest value.
    """
    d = pixels.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.avg("y").alias("y"), F.avg("x").alias("x"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), F.max("value").alias("peak"))
    return d.withColumns({"roundness": F.least("h", "w") / F.greatest("h", "w"), "filling": F.col("area") / (F.col("h") * F.col("w"))})
