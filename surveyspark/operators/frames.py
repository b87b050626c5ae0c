"""Selecting, pairing and sampling frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import group_sizes, neighbours, with_index


def every_nth(frames: DataFrame, n: int, group: list[str], order: str = "frame") -> DataFrame:
    return with_index(frames, group, order).filter(F.col("idx") % n == 0)


def first_k(frames: DataFrame, k: int, group: list[str], order: str = "frame") -> DataFrame:
    return with_index(frames, group, order).filter(F.col("idx") < k)


def pair(rgb: DataFrame, infrared: DataFrame, keys: list[str]) -> DataFrame:
    return rgb.join(infrared, keys, "inner")


def unpaired(rgb: DataFrame, infrared: DataFrame, keys: list[str]) -> DataFrame:
    return rgb.join(infrared, keys, "left_anti")


def sample_distributed(frames: DataFrame, k: int, group: list[str], order: str = "frame") -> DataFrame:
    """k positions trunc(linspace(0, n-1, k)) of each group; groups of at most k frames stay whole."""
    d = group_sizes(with_index(frames, group, order), group)
    last = F.col("n_group") - 1
    # Position p is drawn when p = trunc(i * last / (k-1)) for the only i that can give it.
    i = F.ceil(F.col("idx") * F.lit(float(k - 1)) / last)
    hit = (i <= k - 1) & (F.floor(i * last / F.lit(float(k - 1))) == F.col("idx"))
    return d.filter((F.col("n_group") <= k) | hit)


def sample_increment(frames: DataFrame, step: int, cap: int, group: list[str], order: str = "frame") -> DataFrame:
    return with_index(frames, group, order).filter((F.col("idx") % step == 0) & (F.col("idx") < step * cap))


def sample_random(frames: DataFrame, k: int, seed: int = 42, order: str = "frame") -> DataFrame:
    """The ``k`` frames whose number hashes lowest; the hash is plain arithmetic, so any engine draws the same ones."""
    h = ((F.col(order) % 1000003) * 7919 + seed * 104729) % 1000003
    return frames.orderBy((h * h + 12345) % 1000003, order).limit(k)


def gaps(frames: DataFrame, group: list[str], order: str = "frame") -> DataFrame:
    d = neighbours(with_index(frames, group, order), group, {"next_frame": lambda w: F.lead(order).over(w)}, before=0, after=1)
    return d.filter("next_frame is not null").withColumn("gap", F.col("next_frame") - F.col(order))
