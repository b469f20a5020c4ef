"""Robust linear fits in rounds of summed normal equations, with covariances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, few, stored
from .quantiles import bracketed_median
from .raster import of_keys
from .rings import MAD


def solved(df: DataFrame, keys: tuple[str, ...], y: str, xs: tuple[str, ...]) -> DataFrame:
    """Rows (*keys, n, coef, covariance, spread): least squares of y on the columns xs, from sums of products that partial aggregation merges.

    The unit of covariance is the residual variance over n - len(xs); its rows follow each other. Coefficients of a singular
    system are those of least norm; the covariance is then null.
    """
    k = len(xs)
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = F.array(*[product(a, b) for a in xs for b in xs], *[product(a, y) for a in xs], product(y, y))
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"))

    def solve(batches):
        for b in batches:
            coef, covariance, spread = [], [], []
            for n, s in zip(b.column("n").to_pylist(), b.column("sums").to_pylist()):
                if not n or any(x is None for x in s):
                    coef, covariance, spread = [*coef, None], [*covariance, None], [*spread, None]
                    continue
                a, r = np.array(s[: k * k]).reshape(k, k), np.array(s[k * k : -1])
                c = np.linalg.lstsq(a, r, rcond=None)[0]
                variance = max(s[-1] - 2 * c @ r + c @ a @ c, 0.0) / max(n - k, 1)
                coef.append(c.tolist())
                spread.append(float(np.sqrt(variance)))
                covariance.append((variance * np.linalg.inv(a)).reshape(-1).tolist() if np.linalg.matrix_rank(a) == k else None)
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), b.column("n"), pa.array(coef, many), pa.array(covariance, many), pa.array(spread, pa.float64())], names=[*keys, "n", "coef", "covariance", "spread"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]
    return d.mapInArrow(solve, ", ".join([*kinds, "n long", "coef array<double>", "covariance array<double>", "spread double"]))


def compared(df: DataFrame, y: str, models: dict[str, tuple[str, ...]], *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, model, n, coef, errors, rms): least squares of y on the columns of each model, on the rows that have all columns of all models.

    The sums of products of all columns are made in one pass, and each model is solved from its part of them, so that models are compared on the same rows and a further
    one costs no further pass. rms is over n less the number of columns; errors of a singular model are null.
    """
    xs = tuple(dict.fromkeys(c for m in models.values() for c in m))
    k = len(xs)
    d = df.where(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in (y, *xs)))
    product = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    sums = F.array(*[product(a, b) for a in xs for b in xs], *[product(a, y) for a in xs], product(y, y))
    d = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"))

    def solve(batches):
        many = pa.list_(pa.float64())
        for b in batches:
            rows = []
            for at, (n, s) in enumerate(zip(b.column("n").to_pylist(), b.column("sums").to_pylist())):
                if not n:
                    continue
                whole, right = np.array(s[: k * k]).reshape(k, k), np.array(s[k * k : -1])
                for name, columns in models.items():
                    own = [xs.index(c) for c in columns]
                    a, r = whole[np.ix_(own, own)], right[own]
                    c = np.linalg.lstsq(a, r, rcond=None)[0]
                    variance = max(s[-1] - 2 * c @ r + c @ a @ c, 0.0) / max(n - len(own), 1)
                    errors = np.sqrt(variance * np.diag(np.linalg.inv(a))).tolist() if np.linalg.matrix_rank(a) == len(own) else None
                    rows.append((at, name, n, c.tolist(), errors, float(np.sqrt(variance))))
            index, *rest = zip(*rows) if rows else ([], [], [], [], [], [])
            kinds = (pa.string(), pa.int64(), many, many, pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(index, pa.int64())) for c in keys), *(pa.array(x, t) for x, t in zip(rest, kinds))], names=[*keys, "model", "n", "coef", "errors", "rms"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]
    return d.mapInArrow(solve, ", ".join([*kinds, "model string, n long, coef array<double>, errors array<double>, rms double"]))


def predicted(xs: tuple[str, ...]) -> Column:
    """The value of a fit `coef` at the columns xs."""
    return sum((F.col("coef")[k] * F.col(x) for k, x in enumerate(xs)), F.lit(0.0))


def robust_linear(df: DataFrame, y: str, xs: tuple[str, ...], *, keys: tuple[str, ...] = (), clip: float = 2.5, rounds: int = 6, floor: float = 0.0, again: bool = False, about_median: bool = True, large: bool = False, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows (*keys, n, coef, covariance, spread), rows (*keys, *carry, y, *xs, kept)): fits without rows whose residual is beyond `clip` robust deviations.

    The robust deviation is 1.4826 times the median absolute residual of the rows kept so far, about their median residual or (not `about_median`)
    about zero, and at least `floor`. A row that went stays out, or with `again` is judged anew each round. Rounds end when no row changes, at
    most after `rounds`; the last fit is on the rows then kept. Rows with a missing value take no part.

    A round is one pass of sums, which merge before the shuffle, and two medians: of groups that fit a task by Spark's median, or with `large` by
    brackets, in two passes each. The slim table is stored once a round. Fits and medians of counted, few keys go to the rows, which then do not move.
    """
    columns = [y, *xs]
    d = df.select(*keys, *carry, *[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c))
    d = stored(d.withColumn("kept", F.lit(True)))
    middle = lambda rows, c: (bracketed_median(rows, keys, c).select(*keys, "median") if large else rows.groupBy(*keys).agg(F.median(c).alias("median")))
    for _ in range(rounds):
        fit = few(solved(d.where("kept"), keys, y, xs).select(*keys, "coef"))
        r = of_keys(d, keys, fit).withColumn("res", F.col(y) - predicted(xs)).drop("coef")
        mid = middle(r.where("kept"), "res") if about_median else r.groupBy(*keys).agg(F.lit(0.0).alias("median"))
        r = of_keys(r, keys, few(mid)).withColumn("off", F.abs(F.col("res") - F.col("median"))).drop("median", "res")
        spread = middle(r.where("kept"), "off")
        near = F.col("off") <= clip * F.greatest(MAD * F.col("median"), F.lit(floor))
        new = stored(of_keys(r, keys, few(spread)).withColumn("now", near if again else F.col("kept") & near).select(*keys, *carry, *columns, "kept", "now"))
        d = new.drop("kept").withColumnRenamed("now", "kept")
        if new.where("kept <> now").isEmpty():
            break
    return solved(d.where("kept"), keys, y, xs), d


def polynomial(x: Column, y: Column, order: int) -> dict[str, Column]:
    """The terms x^i y^j of a surface of an order, by name."""
    power = lambda c, n: F.lit(1.0) if not n else c if n == 1 else F.pow(c, F.lit(float(n)))
    return {f"t{i}{j}": power(x, i) * power(y, j) for i in range(order + 1) for j in range(order + 1 - i)}


def sky_surface(pixels: DataFrame, sky: Column, height: int, width: int, *, order: int = 2, clip: float = 2.5, rounds: int = 5, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows (y, x, sky), the fit): a polynomial in the position fitted robustly to the pixels (y, x, value) for which `sky` holds, at every pixel.

    Positions run from -1 to 1 over the raster. Every such pixel takes part; fewer than `least` are refused. One image is one group, so medians are taken
    by brackets.
    """
    x, y = (F.col("x") - width / 2) / (width / 2), (F.col("y") - height / 2) / (height / 2)
    terms = polynomial(x, y, order)
    d = pixels.where(sky & F.col("value").isNotNull()).select(F.col("value").alias("z"), *[c.alias(k) for k, c in terms.items()])
    if (n := d.limit(least).count()) < least:
        raise ValueError(f"only {n} pixels of sky")
    fit, _ = robust_linear(d, "z", tuple(terms), clip=clip, rounds=rounds, again=True, large=True)
    fit = cut(fit)
    at = pixels.select("y", "x", *[c.alias(k) for k, c in terms.items()])
    return of_keys(at, (), fit.select("coef")).select("y", "x", predicted(tuple(terms)).alias("sky")), fit
