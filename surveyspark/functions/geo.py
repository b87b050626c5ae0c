"""Coordinate arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, METRES_PER_DEGREE, Camera

_M = F.lit


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def dms_to_decimal(deg, minute, sec, ref: Column) -> Column:
    v = _c(deg) + _c(minute) / F.lit(60.0) + _c(sec) / F.lit(3600.0)
    return v * F.when(F.upper(ref).isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))


def yaw_to_heading(yaw: Column) -> Column:
    return F.when(yaw < 0, yaw + F.lit(360.0)).otherwise(yaw)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    sa, so = F.sin(dlat / 2), F.sin(dlon / 2)
    a = sa * sa + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * so * so
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def equirect_m(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance at the mean latitude."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dy = (lat2 - lat1) * F.lit(METRES_PER_DEGREE)
    dx = (lon2 - lon1) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def ground_width(alt: Column, fov_deg: float = 45.0) -> Column:
    return F.lit(2.0) * alt * F.tan(F.radians(F.lit(fov_deg / 2)))


def ground_height(alt: Column, cam: Camera = Camera()) -> Column:
    return ground_width(alt, cam.fov_deg) * F.lit(cam.height / cam.width)


def gsd(alt: Column, cam: Camera = Camera()) -> Column:
    return ground_width(alt, cam.fov_deg) / F.lit(cam.width)


def gsd_sensor(alt: Column, sensor_mm: float, pixels: int, focal_mm: float = 10.0) -> Column:
    return alt * F.lit(sensor_mm) / F.lit(focal_mm * pixels)


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return x * c - y * s, x * s + y * c


def offset_latlon(lat: Column, lon: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    return (
        lat + north_m / F.lit(METRES_PER_DEGREE),
        lon + east_m / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))),
    )


def pixel_to_latlon(x, y, lat: Column, lon: Column, alt: Column, heading: Column, cam: Camera = Camera()):
    """(lat, lon) of an infrared pixel; NULL heading means north-up."""
    g = gsd(alt, cam)
    east = (_c(x) - F.lit(cam.width / 2)) * g
    north = -(_c(y) - F.lit(cam.height / 2)) * g
    e, n = rotate(east, north, -F.coalesce(heading.cast("double"), F.lit(0.0)))
    return offset_latlon(lat, lon, e, n)


def pixel_to_latlon_rgb(x, y, lat, lon, alt, heading, model: str = "fov80", cam: Camera = Camera()):
    """Older projections through RGB pixel space; they rotate by +heading.

    fov80: 80 degree lens, centred 0.7 crop; fov75: same lens model at 75 degrees;
    sensor: 13.2 x 8.8 mm sensor at 10 mm, crop 1/6.4 x 1/6; flat: altitude x 1e-4 per pixel, no rotation.
    """
    w, h = cam.rgb_width, cam.rgb_height
    rx = ry = cam.crop_ratio
    if model in ("fov80", "fov75"):
        gx = gy = ground_width(alt, 80.0 if model == "fov80" else 75.0) / F.lit(w)
    elif model == "sensor":
        rx, ry = cam.width / w, cam.height / h
        gx, gy = gsd_sensor(alt, 13.2, w), gsd_sensor(alt, 8.8, h)
    elif model == "flat":
        rx = ry = 1.0
        gx = gy = alt * F.lit(0.0001)
    else:
        raise ValueError(model)
    east = (_c(x) / F.lit(cam.width) - F.lit(0.5)) * F.lit(w * rx) * gx
    north = -(_c(y) / F.lit(cam.height) - F.lit(0.5)) * F.lit(h * ry) * gy
    if model != "flat":
        east, north = rotate(east, north, F.coalesce(heading.cast("double"), F.lit(0.0)))
    return offset_latlon(lat, lon, east, north)


def infrared_to_rgb_xy(x, y, ratio: float, rotation_deg: float = 0.0, cam: Camera = Camera()):
    """Infrared pixel to RGB pixel: centred crop of the given ratio, then a turn about the centre."""
    cx, cy = cam.rgb_width / 2, cam.rgb_height / 2
    dx = (_c(x) / F.lit(cam.width) - F.lit(0.5)) * F.lit(cam.rgb_width * ratio)
    dy = (_c(y) / F.lit(cam.height) - F.lit(0.5)) * F.lit(cam.rgb_height * ratio)
    if rotation_deg:
        dx, dy = rotate(dx, dy, F.lit(rotation_deg))
    return dx + F.lit(cx), dy + F.lit(cy)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def footprint_corners(lat: Column, lon: Column, alt: Column, heading: Column, cam: Camera = Camera()) -> Column:
    """Closed ring of the four ground corners, bottom-left first."""
    hw, hh = ground_width(alt, cam.fov_deg) / 2, ground_height(alt, cam) / 2

    def corner(sx: int, sy: int) -> Column:
        e, n = rotate(hw * F.lit(sx), hh * F.lit(sy), -heading.cast("double"))
        la, lo = offset_latlon(lat, lon, e, n)
        return point(lo, la)

    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(*[corner(*s) for s in signs])


def bearing(dlat_m: Column, dlon_m: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dlon_m, dlat_m)), F.lit(360.0))


COMPASS = ["North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest"]


def compass(angle: Column) -> Column:
    sector = F.floor(F.pmod(angle + F.lit(22.5), F.lit(360.0)) / F.lit(45.0))
    return F.element_at(F.array(*[F.lit(n) for n in COMPASS]), (sector + 1).cast("int"))


def overlap(distance: Column, width_m: Column, pixels: int = 640) -> dict[str, Column]:
    m = F.when(distance >= width_m, F.lit(0.0)).otherwise(width_m - distance)
    return {
        "overlap_m": m,
        "overlap_pct": m / width_m * 100,
        "overlap_px": F.floor(m / (width_m / F.lit(pixels))),
    }


def turn_deg(heading: Column, previous: Column) -> Column:
    """Signed smallest turn in (-180, 180]."""
    d = F.pmod(heading - previous, F.lit(360))
    return F.when(d > 180, d - 360).otherwise(d)
