"""Raw sensor counts to temperature, and normalisations."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def celsius(raw: Column) -> Column:
    """Deci-kelvin counts to degrees Celsius."""
    return raw / F.lit(10.0) - F.lit(273.15)


def celsius_centi(raw: Column) -> Column:
    return (raw - F.lit(27315)) / F.lit(100.0)


# Fixed calibration values of the radiometric conversion.
PLANCK_R, PLANCK_B, PLANCK_F, PLANCK_O = 16384.0, 1428.0, 1.0, -7340.0


def celsius_planck(raw: Column, emissivity: float = 0.95) -> Column:
    safe = F.when(raw == 0, F.lit(1)).otherwise(raw).cast("double")
    kelvin = F.lit(PLANCK_B) / F.log(F.lit(PLANCK_R) / (safe - F.lit(PLANCK_O)) + F.lit(PLANCK_F))
    return (kelvin - F.lit(273.15)) * F.lit(emissivity)


def unit_hypotheses(raw: Column, lo: Column, hi: Column) -> Column:
    """array<struct<unit,celsius>> under every unit the counts might be in; lo/hi are the scene extremes."""
    scale = F.lit(10.0) / (hi - lo)
    rows = [
        ("centi_kelvin", raw / F.lit(100.0) - F.lit(273.15)),
        ("deci_kelvin", celsius(raw)),
        ("ten_kelvin", raw * F.lit(10.0) - F.lit(273.15)),
        ("fitted_scale", raw * scale + (F.lit(293) - lo * scale) - F.lit(273.15)),
    ]
    return F.array(*[F.struct(F.lit(n).alias("unit"), c.cast("double").alias("celsius")) for n, c in rows])


def minmax_norm(value: Column, keys: list[str], eps: float = 0.0) -> Column:
    w = Window.partitionBy(*keys)
    lo = F.min(value).over(w)
    span = F.max(value).over(w) - lo
    return (value - lo) / (F.nullif(span, F.lit(0)) if eps == 0.0 else span + F.lit(eps))
