"""The geodetic functions for users of SQL: temporary functions of the session, expanded into the plan like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import EARTH_RADIUS_M, METRES_PER_DEGREE, Camera


def _moved(e: str, n: str, heading: str) -> tuple[str, str]:
    """Latitude and longitude after e metres east and n metres north, turned by -heading."""
    a = f"radians(-coalesce({heading}, 0e0))"
    east, north = f"(({e}) * cos({a}) - ({n}) * sin({a}))", f"(({e}) * sin({a}) + ({n}) * cos({a}))"
    return f"lat + {north} / {METRES_PER_DEGREE}D", f"lon + {east} / ({METRES_PER_DEGREE}D * cos(radians(lat)))"


def definitions(cam: Camera = Camera()) -> dict[str, str]:
    """Name to signature, result and body."""
    half = "sin((radians(lat2) - radians(lat1)) / 2)", "sin((radians(lon2) - radians(lon1)) / 2)"
    a = f"({half[0]} * {half[0]} + cos(radians(lat1)) * cos(radians(lat2)) * {half[1]} * {half[1]})"
    width = f"(2D * alt * tan(radians({cam.fov_deg / 2}D)))"
    gsd = f"({width} / {cam.width})"
    lat, lon = _moved(f"(x - {cam.width / 2}D) * {gsd}", f"-(y - {cam.height / 2}D) * {gsd}", "heading")
    corner = _moved(f"sx * {width} / 2", f"sy * {width} * {cam.height / cam.width}D / 2", "heading")
    two = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
    place = "lat DOUBLE, lon DOUBLE, alt DOUBLE, heading DOUBLE"
    return {
        "haversine_m": f"({two}) RETURNS DOUBLE RETURN {2 * EARTH_RADIUS_M}D * atan2(sqrt({a}), sqrt(1D - {a}))",
        "equirect_m": f"({two}) RETURNS DOUBLE RETURN {METRES_PER_DEGREE}D * sqrt(pow(lat2 - lat1, 2) + pow((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2))",
        "pixel_to_latlon": f"(x DOUBLE, y DOUBLE, {place}) RETURNS STRUCT<lat: DOUBLE, lon: DOUBLE> RETURN named_struct('lat', {lat}, 'lon', {lon})",
        "footprint_corners": f"""({place}) RETURNS TABLE (corner INT, lon DOUBLE, lat DOUBLE) RETURN
            SELECT corner, {corner[1]}, {corner[0]} FROM VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1) AS t(corner, sx, sy)""",
    }


def register(spark: SparkSession, cam: Camera = Camera()) -> list[str]:
    """Creates or replaces the session's functions and returns their names. ``footprint_corners`` gives rows: use it
    after FROM, with LATERAL where its arguments are columns. A null heading means north-up; other nulls give null."""
    for name, rest in definitions(cam).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(definitions(cam))
