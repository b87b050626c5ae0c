"""Rings as array<struct<lon double, lat double>> with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import METRES_PER_DEGREE


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def mean_of(ring: Column, field: str) -> Column:
    return _sum(F.transform(ring, lambda p: p[field])) / F.size(ring)


def cross_sum(ring: Column) -> Column:
    """Twice the signed area of the (closed) ring in degrees, taken about its first vertex."""
    n = F.size(ring)
    lon0, lat0 = ring[0]["lon"], ring[0]["lat"]
    head, tail = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return _sum(
        F.zip_with(
            head,
            tail,
            lambda p, q: (p["lon"] - lon0) * (q["lat"] - lat0) - (q["lon"] - lon0) * (p["lat"] - lat0),
        )
    )


def area_m2(ring: Column) -> Column:
    """Shoelace area on local metres; fewer than three points give zero."""
    scale = F.lit(METRES_PER_DEGREE**2) * F.cos(F.radians(mean_of(ring, "lat")))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(cross_sum(ring)) * scale / 2)


def area_deg_m2(ring: Column) -> Column:
    """Square degrees times 111 000 squared, without the cosine."""
    return F.abs(cross_sum(close(ring))) / 2 * F.lit(111000.0 * 111000.0)


def centroid(ring: Column) -> Column:
    body = F.slice(ring, F.lit(1), F.size(ring) - 1)
    return F.struct(mean_of(body, "lon").alias("lon"), mean_of(body, "lat").alias("lat"))


def close(ring: Column) -> Column:
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ccw(ring: Column) -> Column:
    return F.when(cross_sum(ring) < 0, F.reverse(ring)).otherwise(ring)


def normalise(json_text: Column) -> Column:
    """Read [[lon,lat],...] or [{lon,lat},...]; drop short rings; close; counter-clockwise."""
    pairs = F.from_json(json_text, "array<array<double>>")
    objs = F.from_json(json_text, "array<struct<lon:double,lat:double>>")
    from_pairs = F.transform(pairs, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    ring = F.when(F.substring(F.regexp_replace(json_text, r"\s", ""), 1, 2) == "[{", objs).otherwise(from_pairs)
    return F.when(F.size(ring) >= 3, ccw(close(ring)))


def decimate(ring: Column, step: Column | int) -> Column:
    s = step if isinstance(step, Column) else F.lit(step)
    return F.filter(ring, lambda p, i: i % s == 0)


def bbox(ring: Column) -> Column:
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(
        F.array_min(lon).alias("min_lon"),
        F.array_max(lon).alias("max_lon"),
        F.array_min(lat).alias("min_lat"),
        F.array_max(lat).alias("max_lat"),
    )


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule over the edges of a closed ring."""
    n = F.size(ring)
    crossings = F.zip_with(
        F.slice(ring, F.lit(1), n - 1),
        F.slice(ring, F.lit(2), n - 1),
        lambda p, q: F.when(
            ((p["lat"] > lat) != (q["lat"] > lat))
            & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]),
            F.lit(1),
        ).otherwise(F.lit(0)),
    )
    return F.aggregate(crossings, F.lit(0), lambda a, v: a + v) % 2 == 1


def edges(ring: Column) -> Column:
    """The sides of a closed ring, each with both its ends."""
    n = F.size(ring)
    side = lambda p, q: F.struct(p["lon"].alias("x0"), p["lat"].alias("y0"), q["lon"].alias("x1"), q["lat"].alias("y1"))
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), side)


def crossings(sides: Column, lat: Column) -> Column:
    """Where the ``edges`` of a ring cross a parallel, from west to east: ``contains`` counts those east of a point."""
    at = lambda e: F.when((e["y0"] > lat) != (e["y1"] > lat), (e["x1"] - e["x0"]) * (lat - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
    return F.sort_array(F.array_compact(F.transform(sides, at)))


def square(lon: Column, lat: Column, half: Column) -> Column:
    """Closed counter-clockwise square ring around a point."""
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(
        *[F.struct((lon + half * a).alias("lon"), (lat + half * b).alias("lat")) for a, b in signs]
    )


def parse_kml(text: Column) -> Column:
    """'lon,lat,alt' tokens to a ring."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != "")
    return F.transform(
        tokens,
        lambda s: F.struct(
            F.split(s, ",")[0].cast("double").alias("lon"), F.split(s, ",")[1].cast("double").alias("lat")
        ),
    )


def to_kml(ring: Column, fmt: str = "%.6f,%.6f,0") -> Column:
    return F.array_join(F.transform(ring, lambda p: F.format_string(fmt, p["lon"], p["lat"])), " ")
