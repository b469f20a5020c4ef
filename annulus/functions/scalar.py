"""Geometry, photometry and tone functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def position_angle(dx: Column, dy: Column, north: float = 0.0, mirrored: bool = False) -> Column:
    """Degrees from north through east of a vector in image axes (y down); in a mirrored image east lies clockwise."""
    turned = F.degrees(F.atan2(dx, -dy))
    return F.pmod(turned - F.lit(north) if mirrored else F.lit(north) - turned, F.lit(360.0))


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    t = clip((x - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def stretch(x: Column, lo: float, hi: float, gamma: float = 1.0) -> Column:
    return F.pow(clip((x - lo) / (hi - lo), 0.0, 1.0), F.lit(1.0 / gamma))


def to_code(x: Column, bits: int = 16) -> Column:
    """A value from 0 to 1 as an unsigned code, halves to even."""
    return F.rint(clip(x, 0.0, 1.0) * (2**bits - 1)).cast("int")


def soft_log(s: Column, floor: float) -> Column:
    """Logarithm that bends to a floor and stays defined for negative signals."""
    e = F.lit(float(floor))
    root = F.sqrt(s * s / 4 + e * e)
    return F.when(s < 0, F.log(e * e / (root - s / 2))).otherwise(F.log(s / 2 + root))


def upsilon(x: Column, power: float, mid: float = 0.5) -> Column:
    return F.when(x < mid, F.pow(2 * x, F.lit(power)) / 2).otherwise(1 - F.pow(2 - 2 * x, F.lit(power)) / 2)


def air_mass(altitude: Column) -> Column:
    """Kasten and Young (1989). The constants of their formula."""
    return 1 / (F.sin(F.radians(altitude)) + 0.50572 * F.pow(altitude + 6.07995, F.lit(-1.6364)))


def magnitude(flux: Column) -> Column:
    return F.when(flux > 0, -2.5 * F.log10(flux))


def image_angle(pa: Column, north: float = 0.0, mirrored: bool = False) -> Column:
    """The inverse of `position_angle`: degrees in image axes."""
    return F.pmod(F.lit(north) + pa if mirrored else F.lit(north) - pa, F.lit(360.0))


def unit(axis: tuple[float, float]) -> tuple[float, float]:
    size = math.hypot(*axis)
    return axis[0] / size, axis[1] / size


def frame_to_pixel(radius: Column, angle: Column, centre: tuple[float, float], scale: float, north: tuple[float, float], east: tuple[float, float]) -> tuple[Column, Column]:
    """(x, y) of a radius in units of `scale` pixels and an angle from north to east, whose directions in the image need not be square to each other."""
    n, e = unit(north), unit(east)
    a, b = radius * F.cos(F.radians(angle)), radius * F.sin(F.radians(angle))
    return centre[0] + scale * (a * n[0] + b * e[0]), centre[1] + scale * (a * n[1] + b * e[1])


def pixel_to_frame(x: Column, y: Column, centre: tuple[float, float], scale: float, north: tuple[float, float], east: tuple[float, float]) -> tuple[Column, Column]:
    """(radius, angle) of a pixel: the exact inverse of `frame_to_pixel`."""
    n, e = unit(north), unit(east)
    det = n[0] * e[1] - e[0] * n[1]
    dx, dy = (x - centre[0]) / scale, (y - centre[1]) / scale
    a, b = (e[1] * dx - e[0] * dy) / det, (n[0] * dy - n[1] * dx) / det
    return F.sqrt(a * a + b * b), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def full_resolution(matrix: Column) -> Column:
    """An affine map between images of half size (six numbers, rows) as one between pixels of full size: sample k of half size has its centre at 2 k + 0.5."""
    m = [matrix[k] for k in range(6)]
    move = lambda a, b, c: 2 * c + 0.5 - 0.5 * (a + b)
    return F.array(m[0], m[1], move(m[0], m[1], m[2]), m[3], m[4], move(m[3], m[4], m[5]))


def srgb_code(x: Column, bits: int = 16) -> Column:
    """The code of 8 or 16 bits of a value from 0 to 1 under the sRGB curve, halves to even; nothing is 0."""
    x = F.coalesce(F.when(~F.isnan(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))
    # The curve of the standard.
    curve = F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    return F.rint(curve * (2**bits - 1)).cast("int")


def mid_exposure(taken: Column, fraction: Column, exposure: Column, offset_hours: float) -> Column:
    """UTC micros at the middle of an exposure from the text of its start `yyyy:MM:dd HH:mm:ss`, the digits after the second (or none) and its length in seconds."""
    start = F.unix_micros(F.to_timestamp(taken, "yyyy:MM:dd HH:mm:ss"))
    digits = F.coalesce(F.concat(F.lit("0."), F.when(fraction != "", fraction)).try_cast("double"), F.lit(0.0))
    return start + F.rint((digits + exposure / 2 - 3600 * offset_hours) * 1e6).cast("long")


def labelled_magnitude(label: Column) -> Column:
    """The number after `V =` of a label, written with a decimal comma; null if there is none."""
    return F.translate(F.nullif(F.regexp_extract(label, r"V\s*=\s*([0-9]+,[0-9]+)", 1), F.lit("")), ",", ".").cast("double")


def direction(angle: Column) -> Column:
    """Unit vector (dx, dy) of an image angle, y down."""
    return F.struct(F.sin(F.radians(angle)).alias("dx"), (-F.cos(F.radians(angle))).alias("dy"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.25 * r + 0.5 * g + 0.25 * b


def calibrated(raw: Column, dark: Column, flat: Column) -> Column:
    """Dark-subtracted, flat-divided value; null where the flat has no positive value."""
    return F.when(flat > 0, (raw - dark) / flat)


def saturated(raw: Column, white: float, pedestal: float, share: float) -> Column:
    return raw >= pedestal + share * (white - pedestal)


def tone_map(r: Column, g: Column, b: Column, scale: float, strength: float = 10.0, ceiling: float = 0.9) -> list[Column]:
    """asinh per channel, then one factor for all three that bends the brightest below `ceiling`."""
    up = [F.asinh(F.greatest(c, F.lit(0.0)) / scale * strength) / F.asinh(F.lit(strength)) for c in (r, g, b)]
    peak = F.greatest(*up)
    factor = F.when(peak > 0, -ceiling * F.expm1(-peak / ceiling) / peak).otherwise(0.0)
    return [u * factor for u in up]


def extinction(mass: Column, reference: float, k: float) -> Column:
    return F.pow(F.lit(10.0), 0.4 * k * (mass - reference))


def baumbach(radius: Column) -> Column:
    """Corona brightness in units of the mean disc (1937). The coefficients of the law."""
    r = F.greatest(radius, F.lit(1.0))
    return 1e-6 * (0.0532 * F.pow(r, F.lit(-2.5)) + 1.425 * F.pow(r, F.lit(-7.0)) + 2.565 * F.pow(r, F.lit(-17.0)))


def soft_mask(distance: Column, radius: float, edge: float) -> Column:
    """0 within `radius`, 1 beyond its soft edge."""
    return clip((distance - radius) / edge, 0.0, 1.0)


def decimal_comma(x: Column, digits: int = 2) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", x), ".", ",")


def star_label(hip: Column, tyc: Column, kind: Column, v: Column) -> Column:
    """Catalogue number (the first that is known), spectral type and magnitude, without what is missing."""
    number = F.coalesce(F.concat(F.lit("HIP "), hip.cast("string")), F.concat(F.lit("TYC "), tyc))
    return F.when(number.isNull(), "").otherwise(F.concat_ws(", ", number, kind, F.concat(F.lit("V="), decimal_comma(v))))


def tangent_plane(ra: Column, dec: Column, ra0: float, dec0: float) -> dict[str, Column]:
    """Gnomonic coordinates xi, eta (arc seconds) and separation sep (degrees) from a centre, all angles in degrees."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(F.lit(dec0))
    den = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    xi, eta = F.cos(d) * F.sin(a) / den, (F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)) / den
    return {"xi": F.degrees(xi) * 3600, "eta": F.degrees(eta) * 3600, "sep": F.degrees(F.acos(clip(den, -1.0, 1.0)))}


def blend(base: Column, layer: Column, mode: str, opacity: float) -> Column:
    """`layer` over `base` (both 0 to 1) in one of the modes normal, multiply, overlay."""
    out = {"normal": layer, "multiply": base * layer, "overlay": F.when(base < 0.5, 2 * base * layer).otherwise(1 - 2 * (1 - base) * (1 - layer))}[mode]
    return base + (out - base) * opacity
