"""Colour-space conversions and pixel features on r, g, b in 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """h in degrees, s and v in 0..255."""
    r, g, b = _d(r), _d(g), _d(b)
    mx, mn = F.greatest(r, g, b), F.least(r, g, b)
    d = mx - mn
    h = (
        F.when(d == 0, F.lit(0.0))
        .when(mx == r, F.pmod((g - b) / d, F.lit(6.0)))
        .when(mx == g, (b - r) / d + 2.0)
        .otherwise((r - g) / d + 4.0)
        * 60.0
    )
    return {"h": h, "s": F.when(mx == 0, F.lit(0.0)).otherwise(d / mx * 255.0), "v": mx}


# Linear sRGB to XYZ rows divided by the D65 white point.
_XYZ = [
    (0.412453 / 0.95047, 0.357580 / 0.95047, 0.180423 / 0.95047),
    (0.212671, 0.715160, 0.072169),
    (0.019334 / 1.08883, 0.119193 / 1.08883, 0.950227 / 1.08883),
]


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    def linear(c: Column) -> Column:
        v = _d(c) / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    lin = [linear(c) for c in (r, g, b)]

    def f(row) -> Column:
        t = lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2]
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)

    x, y, z = (f(row) for row in _XYZ)
    return {"l": y * 116.0 - 16.0, "a": (x - y) * 500.0, "lb": (y - z) * 200.0}


def blue_dominance(r: Column, g: Column, b: Column, guard: float = 0.0) -> Column:
    """b over max(r, g); both channels must be lit when unguarded, either one otherwise."""
    lit_ = ((r > 0) & (g > 0)) if guard == 0.0 else ((r > 0) | (g > 0))
    return F.when(lit_, _d(b) / (F.greatest(_d(r), _d(g)) + F.lit(guard))).otherwise(F.lit(0.0))


def colour_range(r: Column, g: Column, b: Column) -> Column:
    return _d(F.greatest(r, g, b) - F.least(r, g, b))


def intensity(r: Column, g: Column, b: Column) -> Column:
    return _d(r + g + b) / 3.0


def luminance(r: Column, g: Column, b: Column, kind: str = "601") -> Column:
    w = {"601": (0.2989, 0.5870, 0.1140), "709": (0.2125, 0.7154, 0.0721)}.get(kind)
    if w is None:
        return intensity(r, g, b)
    return _d(r) * w[0] + _d(g) * w[1] + _d(b) * w[2]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, _d(a) / _d(b)).otherwise(F.lit(0.0))


def advanced(r: Column, g: Column, b: Column) -> dict[str, Column]:
    dom = _d(b) - F.greatest(_d(r), _d(g))
    total = _d(r + g + b) + F.lit(1e-6)
    return {
        "rg": _ratio(r, g),
        "rb": _ratio(r, b),
        "gb": _ratio(g, b),
        "bg": _ratio(b, g),
        "blue_excess": dom,
        "blue_excess_sq": dom * dom,
        "chroma": colour_range(r, g, b),
        "r_norm": _d(r) / total,
        "g_norm": _d(g) / total,
        "b_norm": _d(b) / total,
    }


# Threshold in degrees, colour name, KML aabbggrr.
THRESHOLD_COLOURS = [
    (0.25, "lightblue", "7fffff00"),
    (0.5, "yellow", "7f00ffff"),
    (0.75, "lightorange", "7f00aaff"),
    (1.0, "green", "7f00ff00"),
    (1.25, "darkgreen", "7f008000"),
    (1.5, "orange", "7f0080ff"),
    (1.75, "darkorange", "7f0055aa"),
    (2.0, "red", "7f0000ff"),
    (2.5, "purple", "7fff00ff"),
    (3.0, "darkred", "7f000080"),
    (3.5, "brown", "7f004080"),
    (4.0, "black", "7f000000"),
]


def threshold_colour(t: Column) -> Column:
    """struct<name,kml> of the nearest defined threshold; white below and darkblack above the table."""
    table = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(c).alias("kml")) for k, n, c in THRESHOLD_COLOURS]
    )
    best = F.array_min(
        F.transform(table, lambda e: F.struct(F.abs(e["k"] - t).alias("d"), e["k"], e["name"], e["kml"]))
    )

    def fixed(name: str, kml: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kml).alias("kml"))

    near = F.struct(best["name"].alias("name"), best["kml"].alias("kml"))
    return (
        F.when(best["d"] < 0.1, near)
        .when(t < 0.25, fixed("white", "7fffffff"))
        .when(t > 4.0, fixed("darkblack", "7f000000"))
        .otherwise(near)
    )


# Directory line colours in KML order.
DIRECTORY_COLOURS = ["ff0000ff", "ff00ff00", "ffff0000", "ff00ffff", "ffff00ff", "ffffff00"]
