"""Per-frame class and raster statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.infrared import celsius


def surface(ocean: str = "ocean", land: str = "land") -> Column:
    return F.when(F.col(ocean), "ocean").when(F.col(land), "land").otherwise("waves")


def class_stats(px: DataFrame, keys: list[str]) -> DataFrame:
    """Temperature and coverage per class, on class histograms."""
    h = px.groupBy(*keys, surface().alias("surface"), "raw").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("raw").cast("double") - 2731
    m = F.sum(c * F.col("n")) / F.sum("n")
    s = h.groupBy(*keys, "surface").agg(
        F.sum("n").alias("pixels"),
        celsius(m + 2731).alias("mean"),
        (F.sqrt(F.greatest(F.sum(c * c * F.col("n")) / F.sum("n") - m * m, F.lit(0.0))) / 10).alias("std"),
        celsius(F.min("raw")).alias("min"),
        celsius(F.max("raw")).alias("max"),
        celsius(F.percentile("raw", F.lit(0.5), F.col("n"))).alias("median"),
    )
    total = s.groupBy(*keys).agg(F.sum("pixels").alias("_t"))
    return s.join(total, keys).withColumn("coverage_pct", F.col("pixels") / F.col("_t") * 100).drop("_t")


def frame_trends(px: DataFrame, keys: list[str]) -> DataFrame:
    o, l_ = F.col("ocean"), F.col("land")
    d = px.groupBy(*keys).agg(
        celsius(F.avg(F.when(o, F.col("raw")))).alias("ocean_mean"),
        celsius(F.avg(F.when(l_, F.col("raw")))).alias("land_mean"),
        (F.avg(o.cast("int")) * 100).alias("ocean_pct"),
    )
    return d.withColumn("difference", F.col("land_mean") - F.col("ocean_mean"))


def raster_histogram(px: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal bins over each frame's range, last bin closed."""
    ends = px.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    counts = px.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).join(ends, keys)
    b = F.least(F.floor((F.col(value) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))), F.lit(bins - 1))
    return counts.groupBy(*keys, F.coalesce(b, F.lit(bins // 2)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def poly_fit2(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Degree-two least squares by the normal equations, about the centre of x."""
    v = F.col(x).cast("double")
    centre = df.groupBy(*keys).agg(F.avg(v).alias("_c"))
    t, w = F.col(x) - F.col("_c"), F.col(y).cast("double")
    s = df.join(centre, keys).groupBy(*keys).agg(
        F.first("_c").alias("c"),
        F.count(F.lit(1)).cast("double").alias("s0"),
        *[F.sum(F.pow(t, F.lit(float(i)))).alias(f"s{i}") for i in (2, 3, 4)],
        F.sum(w).alias("y0"),
        F.sum(t * w).alias("y1"),
        F.sum(t * t * w).alias("y2"),
    )
    s0, s2, s3, s4, y0, y1, y2 = (F.col(n) for n in ("s0", "s2", "s3", "s4", "y0", "y1", "y2"))
    # With the first moment zero the 3x3 system reduces to two unknowns.
    den = (s4 - s2 * s2 / s0) * s2 - s3 * s3
    a2 = ((y2 - s2 * y0 / s0) * s2 - s3 * y1) / den
    a1 = (y1 - a2 * s3) / s2
    a0 = (y0 - a2 * s2) / s0
    c = F.col("c")
    return s.select(*keys, a2.alias("quadratic"), (a1 - a2 * c * 2).alias("linear"), (a0 - a1 * c + a2 * c * c).alias("constant"))
