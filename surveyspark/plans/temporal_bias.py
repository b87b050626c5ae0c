"""Is detection tied to the time of day?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import temporal as T


def temporal_bias(frames: DataFrame) -> DataFrame:
    """One row of test statistics over ``frames(ts, flight, detected)``."""
    h = T.histograms(frames)
    minutes = frames.withColumn("minute", F.hour("ts") * 60 + F.minute("ts"))
    n = frames.agg(
        F.count(F.lit(1)).alias("n_images"), F.sum(F.col("detected").cast("int")).alias("n_detections"), F.countDistinct("flight").alias("n_flights")
    )
    one = F.lit(1).alias("_one")
    row = n.select("*", one)
    for part in (T.chi_square(h), T.ks_two_sample(minutes, "minute", "detected"), T.peaks(h)):
        row = row.join(part.select("*", one), "_one")
    return row.drop("_one").withColumn("effect", text.effect_size(F.col("cramers_v")))


def with_p_values(spark, result: DataFrame) -> DataFrame:
    """Adds p-values and the worded verdict to the one-row result."""
    r = result.first().asDict()
    r["p_value"] = T.chi_square_p(r["chi2"], r["dof"])
    r["ks_p_value"] = T.ks_p(r["ks_statistic"], r["n_images"], r["n_detections"])
    d = spark.createDataFrame([r])
    return d.withColumn("significance", text.significance(F.col("p_value")))
