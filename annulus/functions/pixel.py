"""Geometry, weights and display of pixels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clip


def distance(x: Column, y: Column, cx: float, cy: float) -> Column:
    """Distance of a pixel to a centre."""
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def in_radii(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return distance(x, y, cx, cy) / radius


def in_disc(x: Column, y: Column, cx: float, cy: float, radius: float, margin: float = 0.0) -> Column:
    return distance(x, y, cx, cy) <= radius + margin


def scaled(c: Column, factor: float) -> Column:
    """A coordinate in the image resampled by `factor`; pixel centres are whole numbers."""
    return (c + 0.5) * factor - 0.5


def to_unsigned(x: Column, most: int = 65535) -> Column:
    """Floats from 0 to 1 as whole numbers, missing ones as 0."""
    return F.bround(clip(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), 0.0, 1.0) * most).cast("int")


def display_byte(x: Column, lo: float, hi: float, gamma: float = 1.0) -> Column:
    return F.floor(255 * F.pow(F.coalesce(clip((x - lo) / (hi - lo), 0.0, 1.0), F.lit(0.0)), F.lit(gamma))).cast("int")


def layer_alpha(alpha: Column, observed: Column) -> Column:
    """The base's alpha where there are data, else 0; an alpha that is null, NaN or not from 0 to 1 makes the query fail when it runs."""
    good = alpha.isNotNull() & ~F.isnan(alpha) & alpha.between(0, 1)
    return F.when(~F.coalesce(good, F.lit(False)), F.raise_error(F.lit("alpha must be finite and from 0 to 1")).cast("double")).when(observed, alpha).otherwise(F.lit(0.0))


def display_chroma(rgb: tuple[Column, Column, Column], luminance, gamma: float, limits: tuple[float, float] = (0.2, 3.0)) -> list[Column]:
    """Ratios to the luminance in linear light, limited, then encoded by `gamma` and made of unit luminance."""
    x = [F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in rgb]
    total = luminance(*x)
    c = [F.pow(F.when(total > 0, clip(v / total, *limits)).otherwise(F.lit(1.0)), F.lit(1.0 / gamma)) for v in x]
    unit = F.greatest(luminance(*c), F.lit(1e-6))
    return [v / unit for v in c]


def red_weight(red: Column, green: Column, radius: Column, band: tuple[float, float] = (0.95, 1.2), ratios: tuple[float, float] = (1.15, 1.6)) -> Column:
    """Weight of chromospheric light, from the ratio of red and green, near the limb only."""
    w = clip(F.when(green > 0, red / green).otherwise(F.lit(0.0)) - ratios[0], 0.0, ratios[1] - ratios[0]) / (ratios[1] - ratios[0])
    return F.when(radius.between(*band), w).otherwise(F.lit(0.0))


def sky(u: Column, v: Column, terms: tuple[float, ...]) -> Column:
    """A sky of one term (constant), three (plane) or six (quadratic)."""
    shapes = [F.lit(1.0), u, v, u * u, u * v, v * v]
    out = F.lit(terms[0]) * shapes[0]
    for t, shape in zip(terms[1:], shapes[1:]):
        out = out + t * shape
    return out


def mixed_channel(rgb: tuple[Column, Column, Column], row: tuple[float, float, float]) -> Column:
    """One row of a colour matrix applied to three channels."""
    return rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]


def exposure_window(f: Column, seconds: Column, floor: float, ceiling: float) -> Column:
    """Weight of a raw value: rises softly over three floors, falls over the last 18 % below the ceiling, times the exposure."""
    return clip((f - floor) / (3.0 * floor), 0.0, 1.0) * clip((ceiling - f) / (0.18 * ceiling), 0.0, 1.0) * seconds


#: Abramowitz and Stegun 7.1.26, exact to 1.5e-7.
ERF_P, ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def noise_gate(d: Column, sigma: Column, n: float) -> Column:
    """A detail times the error function of its size in n deviations of noise: small ones fade softly."""
    return d * erf(F.abs(d) / F.greatest(n * sigma, F.lit(1e-12)))
