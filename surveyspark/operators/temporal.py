"""Time-of-day statistics of captures and detections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decimal_hour

C = F.col


def hour_bin(hour: Column, width: float, lo: float = 6.0, hi: float = 18.0) -> Column:
    """Bin number between lo and hi, last bin closed; NULL outside."""
    n = int(round((hi - lo) / width))
    return F.when(hour.between(lo, hi), F.least(F.floor((hour - lo) / width), F.lit(n - 1)).cast("int"))


def histograms(captures: DataFrame, width: float = 1.0, lo: float = 6.0, hi: float = 18.0, group: list[str] = ()) -> DataFrame:
    """(group, bin, captures, detections) of frames(ts, detected); empty bins are present with zeros.

    Detections are a flag on the capture, so they can never outnumber captures in a bin.
    """
    n = int(round((hi - lo) / width))
    d = captures.withColumn("bin", hour_bin(decimal_hour(C("ts")), width, lo, hi)).filter("bin is not null")
    counts = d.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("captures"), F.sum(C("detected").cast("int")).alias("detections"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")
    if group:
        frame = captures.select(*group).distinct().select(*group, bins)
    else:
        frame = captures.sparkSession.range(1).select(bins)
    return frame.join(counts, [*group, "bin"], "left").fillna(0, ["captures", "detections"])


def rates(hist: DataFrame, width: float, lo: float = 6.0) -> DataFrame:
    r = F.when(C("captures") > 0, C("detections") / C("captures") * 100).otherwise(F.lit(0.0))
    return hist.withColumn("centre", C("bin") * width + lo + width / 2).withColumn("rate", r)


def chi_square(hist: DataFrame) -> DataFrame:
    """One row: chi-square, degrees of freedom, Cramer's V of detected x bin."""
    h = hist.filter("captures > 0")
    t = h.agg(F.struct(F.sum("captures").alias("n"), F.sum("detections").alias("d"), F.count(F.lit(1)).alias("k"))).scalar()
    x = h.withColumn("t", t).withColumn("p", C("t.d") / C("t.n"))
    e1, e0 = C("captures") * C("p"), C("captures") * (1 - C("p"))
    miss = C("captures") - C("detections")
    # Two columns are Yates-corrected, more are not.
    part = lambda o, e: F.pow(F.abs(o - e) - F.when(C("t.k") == 2, F.least(F.lit(0.5), F.abs(o - e))).otherwise(0.0), F.lit(2.0)) / e
    s = x.agg(F.sum(part(C("detections"), e1) + part(miss, e0)).alias("chi2"), F.first("t").alias("t"))
    return s.select(
        "chi2",
        (C("t.k") - 1).alias("dof"),
        C("t.n").alias("n"),
        F.sqrt(C("chi2") / C("t.n")).alias("cramers_v"),
        F.sqrt(C("chi2") / (C("t.n") * 2 - 1)).alias("cramers_v_compat"),
    )


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail by the regularised incomplete gamma series / continued fraction."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def ks_p(stat: float, n: int, m: int) -> float:
    """Asymptotic two-sample tail."""
    t = stat * math.sqrt(n * m / (n + m))
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))) if t > 1e-9 else 1.0


def ks_two_sample(d: DataFrame, value: str, flag: str) -> DataFrame:
    """Largest gap between the distribution of all values and of the flagged ones.

    Values are minutes of the day, so the ordered window runs over at most 1 440 counts.
    """
    v = d.groupBy(value).agg(F.count(F.lit(1)).alias("a"), F.sum(C(flag).cast("int")).alias("b"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    e = v.select((F.sum("a").over(w) / F.sum("a").over(everything) - F.sum("b").over(w) / F.sum("b").over(everything)).alias("gap"))
    return e.agg(F.max(F.abs("gap")).alias("ks_statistic"))


def peaks(hist: DataFrame, width: float = 1.0, lo: float = 6.0) -> DataFrame:
    h = hist.withColumn("centre", C("bin") * width + lo + width / 2)
    return h.agg(
        F.max_by("centre", F.struct("captures", -C("bin"))).alias("peak_capture_hour"),
        F.max_by("centre", F.struct("detections", -C("bin"))).alias("peak_detection_hour"),
    ).withColumn("time_difference", C("peak_detection_hour") - C("peak_capture_hour"))
