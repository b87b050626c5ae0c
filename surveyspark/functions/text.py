"""Names, times, keys and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_number(path: Column) -> Column:
    """Digits after the underscore of the file stem."""
    return F.regexp_extract(path, r"_(\d+)\.[^./]*$", 1).try_cast("int")


def media_dir(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d{3}MEDIA)(?:/|$)", 1), F.lit(""))


def xmp_heading(xmp: Column) -> Column:
    yaw = F.regexp_extract(xmp, r'Camera:Yaw="?([-\d.]+)', 1).try_cast("double")
    return F.when(yaw < 0, yaw + 360).otherwise(yaw)


def area_name(path: Column) -> Column:
    """Model key of a survey directory."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.element_at(parts, -1)
    leaf = F.when(last.endswith("MEDIA") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(last)
    s = F.lower(leaf)
    for a, b in (("flight ", ""), ("flight_", ""), (" - ", "_"), ("-", "_"), (" ", "_")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_]", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed_area"))


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def decimal_hour(ts: Column, offset: int = 0) -> Column:
    """Hour of day with minutes as a fraction; the offset wraps without rolling the date."""
    return F.pmod(F.hour(ts) + F.lit(offset), F.lit(24)) + F.minute(ts) / F.lit(60.0)


def location_hash(lat: Column, lon: Column, digits: int = 6, order: str = "lonlat") -> Column:
    """md5 of the fixed-decimal coordinate pair; exact decimal ties are rounded half up."""
    a, b = (lon, lat) if order == "lonlat" else (lat, lon)
    f = f"%.{digits}f,%.{digits}f"
    return F.md5(F.format_string(f, a, b))


def significance(p: Column) -> Column:
    return (
        F.when(p < 0.001, "highly significant (p < 0.001)")
        .when(p < 0.01, "significant (p < 0.01)")
        .when(p < 0.05, "significant (p < 0.05)")
        .otherwise("not significant (p ≥ 0.05)")
    )


def effect_size(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")


def near_edges(x: Column, y: Column, width: int, height: int, buffer: int) -> Column:
    """Names of the frame edges a point is within ``buffer`` pixels of."""
    return F.array_compact(
        F.array(
            F.when(x < buffer, "left"),
            F.when(x > width - buffer, "right"),
            F.when(y < buffer, "top"),
            F.when(y > height - buffer, "bottom"),
        )
    )


def threshold_series(base: float, step: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(base) + i * F.lit(step))
