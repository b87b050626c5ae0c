"""Sun-glint evidence per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour

C = F.col


def summary(px: DataFrame, keys: list[str], bright: float = 0.8) -> DataFrame:
    """(keys, raw, n, bright, saturated, g_sum, g_squares, g_max) of the ocean: the histogram of counts with sums of
    brightness. Everything the votes need from the pixels themselves, in one read and one partial aggregation."""
    g = colour.luminance(C("r"), C("g"), C("b"), "709") / 255.0
    return px.filter("ocean").withColumn("_g", g).groupBy(*keys, "raw").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(C("_g") > bright, 1)).alias("bright"), F.count(F.when(C("_g") > 0.95, 1)).alias("saturated"),
        F.sum("_g").alias("g_sum"), F.sum(C("_g") * C("_g")).alias("g_squares"), F.max("_g").alias("g_max"),
    )


def rgb_evidence(sums: DataFrame, keys: list[str], area: float = 0.2) -> DataFrame:
    """Brightness of each frame from its ``summary``."""
    n = F.sum("n")
    mean = F.sum("g_sum") / n
    d = sums.groupBy(*keys).agg(
        (F.sum("bright") / n).alias("bright_fraction"), (F.sum("saturated") / n).alias("saturated_fraction"), mean.alias("brightness_mean"),
        F.sqrt(F.greatest(F.sum("g_squares") / n - mean * mean, F.lit(0.0))).alias("brightness_std"), F.max("g_max").alias("brightness_max"),
    )
    flag = (C("bright_fraction") > area) | (C("saturated_fraction") > 0.1) | (C("brightness_mean") > 0.7)
    return d.withColumn("rgb_glint", flag)


def infrared_evidence(hist: DataFrame, plumes: DataFrame, keys: list[str], area: float = 0.2, mads: float = 3.0, round_area: int = 1000) -> DataFrame:
    """Plume share first, then a large round plume, then the share of pixels far below the median."""
    med = hist.groupBy(*keys).agg(F.percentile("raw", F.lit(0.5), C("n")).alias("_m"), F.sum("n").alias("ocean_px"))
    dev = hist.join(med, keys).withColumn("_d", F.abs(C("raw") - C("_m")))
    mad = dev.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5), C("n")).alias("_mad"))
    cold = dev.join(mad, keys).groupBy(*keys).agg(
        F.first("ocean_px").alias("ocean_px"),
        (F.sum(F.when(C("raw") < C("_m") - C("_mad") * mads, C("n")).otherwise(0)) / F.first("ocean_px")).alias("cold_fraction"),
    )
    p = plumes.groupBy(*keys).agg(
        F.sum("area").alias("_px"), F.max_by(F.struct("area", "eccentricity"), F.struct("area", -C("region"))).alias("_big")
    )
    j = cold.join(p, keys, "left").withColumn("plume_fraction", F.coalesce(C("_px"), F.lit(0)) / C("ocean_px"))
    reason = (
        F.when(C("plume_fraction") > area, "plume_area")
        .when((C("_big.eccentricity") < 0.5) & (C("_big.area") > round_area), "round_plume")
        .when(C("cold_fraction") > area, "cold_area")
    )
    return j.select(*keys, "plume_fraction", "cold_fraction", reason.alias("infrared_reason"), reason.isNotNull().alias("infrared_glint"))


def confidence(rgb: DataFrame, infrared: DataFrame, continuity: DataFrame, turns: DataFrame | None, keys: list[str]) -> DataFrame:
    """Weighted vote in whole tenths (4 + 3 + 2 + 1): glint from 5, detections vetoed above 7."""
    d = rgb.join(infrared, keys).join(continuity.select(*keys, "has_discontinuity"), keys)
    d = d.join(turns.select(*keys, "rapid"), keys, "left") if turns is not None else d.withColumn("rapid", F.lit(False))
    votes = [("rgb_glint", 4, "rgb"), ("infrared_glint", 3, "infrared"), ("has_discontinuity", 2, "continuity"), ("rapid", 1, "turn")]
    score = sum((F.when(C(c), k).otherwise(0) for c, k, _ in votes), F.lit(0))
    why = F.array_compact(F.array(*[F.when(C(c), n) for c, _, n in votes]))
    return d.select(
        *keys, score.alias("tenths"), (score >= 5).alias("has_glint"), (score > 7).alias("veto"), F.concat_ws(",", why).alias("reasons")
    )


def veto(detections: DataFrame, verdict: DataFrame, keys: list[str]) -> DataFrame:
    return detections.join(verdict.filter("veto").select(*keys), keys, "left_anti")
