"""Survey-shaped views over the parquet tables that feed the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Camera, DetectConfig

# The stored rasters are 8 x 8; radii and areas shrink with them.
W = H = 8
SMALL = DetectConfig(
    threshold=0.5, min_area=2, max_area=20, max_shore=1.0, edge_shore=2.0, edge_buffer=1, camera=Camera(width=8, height=8)
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str, colocate: list[str] | None = None) -> DataFrame:
    """One row per pixel.

    ``colocate`` hash-partitions the compact one-row-per-frame arrays by the given keys before they are
    exploded, so every later groupBy, window or join on these keys runs without another exchange.
    """
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), "label", "embedding")
    e = e.withColumn("media", (F.lit(100) + F.col("frame") % 8).cast("int"))
    if colocate:
        e = e.repartition(*colocate)
    p = e.select("frame", "media", "label", F.posexplode("embedding").alias("pos", "v"))
    p = p.select(
        "frame",
        "label",
        F.expr("cast(pos div 8 as int)").alias("y"),
        F.expr("cast(pos % 8 as int)").alias("x"),
        (F.lit(2950) + F.floor(F.col("v").cast("double") * 100)).cast("int").alias("raw"),
        "media",
    )
    m = (F.col("frame") * 31 + F.col("y") * 7 + F.col("x") * 3) % 10
    return p.select(
        "*",
        ((F.col("raw") * 7 + F.col("x") * 13) % 256).cast("int").alias("r"),
        ((F.col("raw") * 11 + F.col("y") * 17) % 256).cast("int").alias("g"),
        ((F.col("raw") * 3 + F.col("x") * F.col("y") * 5) % 256).cast("int").alias("b"),
        (m < 7).alias("ocean"),
        (m >= 9).alias("land"),
        ((m >= 7) & (m < 9)).alias("waves"),
    )


def wide_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Rasters of 64 x 64: 64 stored ones side by side; land lies in one corner tile only, so the shore is far from most pixels."""
    p = pixels(spark, sf)
    tile = F.col("frame") % 64
    corner = (tile == 0) & F.col("land")
    return p.select(
        F.expr("frame div 64").alias("frame"), "media",
        F.expr("cast((frame % 64) div 8 * 8 + y as int)").alias("y"), F.expr("cast(frame % 8 * 8 + x as int)").alias("x"),
        "raw", (~corner).alias("ocean"), corner.alias("land"), F.lit(False).alias("waves"),
    ).drop("media")


def full_size_pixels(spark: SparkSession, sf: str, frames: int, width: int = 640, height: int = 512) -> DataFrame:
    """Frames of a real sensor's size tiled from the stored rasters; land along the top, a few rows of waves below it."""
    across = width // W
    n = table(spark, sf, "embeddings").count()
    tiles = spark.range(frames * across * (height // H)).select(
        F.expr(f"id div {across * (height // H)}").alias("frame"), (F.col("id") % (across * (height // H))).alias("tile"),
    )
    tiles = tiles.withColumn("vec_id", (F.col("tile") * 37 + F.col("frame") * 101) % n)
    e = table(spark, sf, "embeddings").withColumn("vec_id", F.row_number().over(Window.orderBy("vec_id")) - 1).select("vec_id", "embedding")
    p = tiles.join(e, "vec_id").repartition("frame").select("frame", "tile", F.posexplode("embedding").alias("pos", "v"))
    y, x = F.expr(f"cast(tile div {across} * {H} + pos div {W} as int)"), F.expr(f"cast(tile % {across} * {W} + pos % {W} as int)")
    return p.select(
        "frame", F.lit(100).alias("media"), y.alias("y"), x.alias("x"), (F.lit(2950) + F.floor(F.col("v").cast("double") * 100)).cast("int").alias("raw"),
    ).select("*", (F.col("y") >= 50).alias("ocean"), (F.col("y") < 46).alias("land"), F.col("y").between(46, 49).alias("waves"))


def named_frames(d: DataFrame) -> DataFrame:
    """Frames of two surveys with eight directories each, numbered from 0 in every directory, as cameras do."""
    f = F.col("frame")
    return d.withColumns({
        "survey": F.when(f % 16 < 8, "north").otherwise("south"), "media": F.concat(F.lit(100) + f % 8, F.lit("MEDIA")), "frame": F.expr("frame div 16"),
    })


def captures(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        i.alias("frame"),
        F.col("user_id").alias("flight"),
        "ts",
        "event_type",
        "value",
        "props",
        (F.lit(-27.15) + (i % 20) * F.lit(0.0005) + ((i * 7919) % 101) * F.lit(0.000001)).alias("lat"),
        (
            F.lit(-109.44) + (F.expr("event_id div 20") % 20) * F.lit(0.0005) + ((i * 104729) % 103) * F.lit(0.000001)
        ).alias("lon"),
        (F.lit(380) + i % 40).alias("altitude"),
        ((i * 37) % 360).alias("heading"),
        (i % 400).alias("site"),
    )


def directories(captures_: DataFrame) -> DataFrame:
    """The capture log with the directory of each frame."""
    return captures_.withColumn("media", (F.lit(100) + F.col("frame") % 8).cast("int"))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return (
        captures(spark, sf)
        .filter(F.col("event_type") == "purchase")
        .withColumn("area_m2", F.col("value"))
        .withColumn("anomaly", -(F.lit(0.5) + F.col("value") / 100))
        .withColumn("half", (F.lit(1) + F.col("frame") % 5) * F.lit(0.00001))
    )


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Bounding box of the square outline of each detection."""
    d = detections(spark, sf)
    return d.select(
        "frame",
        "area_m2",
        (F.col("lon") - F.col("half")).alias("min_lon"),
        (F.col("lon") + F.col("half")).alias("max_lon"),
        (F.col("lat") - F.col("half")).alias("min_lat"),
        (F.col("lat") + F.col("half")).alias("max_lat"),
    )
