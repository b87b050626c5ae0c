"""Exact temperature baselines on per-frame histograms of raw counts.

A histogram has at most a few thousand distinct counts per frame, merges by addition and answers any
percentile of any pool of frames exactly; pixels are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.infrared import celsius
from .ordered import neighbours, with_index

ZERO_C = 2731  # shift that keeps the second moment small


def temp_hist(pixels: DataFrame, keys: list[str], mask: str = "ocean") -> DataFrame:
    return pixels.filter(F.col(mask)).groupBy(*keys, "raw").agg(F.count(F.lit(1)).alias("n"))


def _mean_raw() -> Column:
    return F.sum(F.col("raw") * F.col("n")) / F.sum("n")


def _std_raw() -> Column:
    d = (F.col("raw") - F.lit(ZERO_C)).cast("double")
    m = F.sum(d * F.col("n")) / F.sum("n")
    return F.sqrt(F.greatest(F.sum(d * d * F.col("n")) / F.sum("n") - m * m, F.lit(0.0)))


def ocean_stats(hist: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("raw", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)]), F.col("n"))
    d = hist.groupBy(*keys).agg(
        q.alias("_q"),
        _mean_raw().alias("_m"),
        (_std_raw() / 10).alias("std"),
        F.min("raw").alias("_lo"),
        F.max("raw").alias("_hi"),
        F.sum("n").alias("n"),
    )
    return d.select(
        *keys,
        celsius(F.col("_q")[1]).alias("median"),
        celsius(F.col("_m")).alias("mean"),
        "std",
        celsius(F.col("_q")[0]).alias("q25"),
        celsius(F.col("_q")[2]).alias("q75"),
        celsius(F.col("_q")[3]).alias("q90"),
        celsius(F.col("_lo")).alias("min"),
        celsius(F.col("_hi")).alias("max"),
        ((F.col("_q")[2] - F.col("_q")[0]) / 10).alias("iqr"),
        "n",
    )


def percentile_baseline(hist: DataFrame, keys: list[str], p: float, out: str = "baseline", approx: bool = False) -> DataFrame:
    """Exact by default; ``approx`` trades exactness for a fixed-size sketch."""
    if approx:
        q = F.expr(f"percentile_approx(raw, {p}, 10000)")
        return hist.select(*keys, F.explode(F.array_repeat("raw", F.col("n").cast("int"))).alias("raw")).groupBy(*keys).agg(celsius(q).alias(out))
    return hist.groupBy(*keys).agg(celsius(F.percentile("raw", F.lit(p), F.col("n"))).alias(out))


def trimmed_mean_baseline(hist: DataFrame, keys: list[str], p: float = 0.25, out: str = "baseline") -> DataFrame:
    """Mean of values at or above the p quantile."""
    cut = hist.groupBy(*keys).agg(F.percentile("raw", F.lit(p), F.col("n")).alias("_cut"))
    return hist.join(cut, keys).filter(F.col("raw") >= F.col("_cut")).groupBy(*keys).agg(celsius(_mean_raw()).alias(out))


def modal_baseline(hist: DataFrame, keys: list[str], bins: int = 50, out: str = "baseline") -> DataFrame:
    """Centre of the first fullest of ``bins`` equal bins; a constant frame is widened by half a degree."""
    ends = hist.groupBy(*keys).agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    d = hist.join(ends, keys)
    flat = F.col("_lo") == F.col("_hi")
    lo = F.when(flat, F.col("_lo") - 5).otherwise(F.col("_lo")).cast("double")
    hi = F.when(flat, F.col("_hi") + 5).otherwise(F.col("_hi")).cast("double")
    b = F.least(F.floor((F.col("raw") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = d.groupBy(*keys, "_lo", "_hi", b.alias("_bin")).agg(F.sum("n").alias("_n"))
    best = counts.groupBy(*keys).agg(
        F.max_by(F.struct("_bin", lo.alias("lo"), hi.alias("hi")), F.struct("_n", -F.col("_bin"))).alias("_t")
    )
    t = F.col("_t")
    return best.select(*keys, celsius(t["lo"] + (t["_bin"] + 0.5) * (t["hi"] - t["lo"]) / bins).alias(out))


BASELINES = {
    "median": lambda h, k: percentile_baseline(h, k, 0.5),
    "upper_quartile": lambda h, k: percentile_baseline(h, k, 0.75),
    "percentile_80": lambda h, k: percentile_baseline(h, k, 0.8),
    "percentile_90": lambda h, k: percentile_baseline(h, k, 0.9),
    "trimmed_mean": trimmed_mean_baseline,
    "modal_peak": modal_baseline,
}


def mad(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Median and median absolute deviation in degrees."""
    med = hist.groupBy(*keys).agg(F.percentile("raw", F.lit(0.5), F.col("n")).alias("_m"))
    dev = hist.join(med, keys).withColumn("_d", F.abs(F.col("raw") - F.col("_m")))
    return dev.groupBy(*keys).agg(
        celsius(F.first("_m")).alias("median"), (F.percentile("_d", F.lit(0.5), F.col("n")) / 10).alias("mad")
    )


def pooled_hist(hist: DataFrame, group: list[str], window: int, order: str = "frame") -> DataFrame:
    """Histogram of the last ``window`` frames at every frame of its group.

    Each histogram row is handed to the frames that look back on it; percentiles of the pool stay exact,
    which no running window over per-frame percentiles would be.
    """
    idx = with_index(hist.select(*group, order).distinct(), group, order)
    spread = hist.join(idx, [*group, order]).select(
        *group, F.explode(F.sequence(F.col("idx"), F.col("idx") + window - 1)).alias("idx"), "raw", "n"
    )
    pooled = spread.groupBy(*group, "idx", "raw").agg(F.sum("n").alias("n"))
    return pooled.join(idx, [*group, "idx"]).drop("idx")


def moving_baseline(hist: DataFrame, group: list[str], window: int = 5, method: str = "median") -> DataFrame:
    return BASELINES[method](pooled_hist(hist, group, window), [*group, "frame"])


def moving_mean_std(hist: DataFrame, group: list[str], window: int = 5) -> DataFrame:
    d = (F.col("raw") - F.lit(ZERO_C)).cast("double")
    per = hist.groupBy(*group, "frame").agg(
        F.sum("n").alias("s0"), F.sum(d * F.col("n")).alias("s1"), F.sum(d * d * F.col("n")).alias("s2")
    )
    span = lambda c: (lambda w: F.sum(c).over(w.rowsBetween(-(window - 1), 0)))
    m = neighbours(
        with_index(per, group, "frame"), group, {"w0": span("s0"), "w1": span("s1"), "w2": span("s2")}, before=window - 1
    )
    mean = F.col("w1") / F.col("w0")
    return m.select(
        *group,
        "frame",
        celsius(mean + ZERO_C).alias("mean"),
        (F.sqrt(F.greatest(F.col("w2") / F.col("w0") - mean * mean, F.lit(0.0))) / 10).alias("std"),
    )


def continuity(medians: DataFrame, group: list[str], jump: float = 2.0) -> DataFrame:
    """Median jumps between successive ocean-bearing frames and deviation from up to four earlier ones."""
    d = neighbours(
        with_index(medians, group, "frame"),
        group,
        {
            "prev_median": lambda w: F.lag("median").over(w),
            "running_avg": lambda w: F.avg("median").over(w.rowsBetween(-4, -1)),
        },
        before=4,
    )
    enough = F.col("idx") >= 2
    d = d.withColumn("temp_jump", F.abs(F.col("median") - F.col("prev_median"))).withColumn(
        "deviation", F.when(enough, F.abs(F.col("median") - F.col("running_avg")))
    )
    flag = (F.col("temp_jump") > jump) | (F.col("deviation") > jump * 1.5)
    return d.withColumn("has_discontinuity", F.coalesce(flag, F.lit(False)))


def stability(baselines: DataFrame, group: list[str]) -> DataFrame:
    return baselines.groupBy(*group).agg(
        F.avg("baseline").alias("mean"),
        F.stddev_pop("baseline").alias("std"),
        F.min("baseline").alias("min"),
        F.max("baseline").alias("max"),
        (F.max("baseline") - F.min("baseline")).alias("range"),
        F.count(F.lit(1)).alias("n_frames"),
    )
