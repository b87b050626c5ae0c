"""The persisted set of unique locations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spatial

C = F.col
COLUMNS = ["location", "lat", "lon", "first_frame", "last_frame", "detection_count", "area_m2", "geometry_frame"]


def upsert(state: DataFrame, new: DataFrame, radius_m: float) -> DataFrame:
    """State after confirming ``new(ord, frame, lat, lon, area_m2)``, all later than what the state holds.

    New points near a known location fold into the first such one; only the rest are folded among
    themselves, so the work follows the new data and the state is joined by cell.
    """
    places = state.select(C("location").alias("ord"), "lat", "lon")
    m = spatial.first_within(new, places, radius_m)
    seen = m.filter("place is not null").groupBy(C("place").alias("location")).agg(
        F.max_by("frame", "ord").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.max("area_m2").alias("_a"),
        F.max_by("frame", F.struct("area_m2", -C("ord"))).alias("_g"),
    )
    larger = C("_a") > C("area_m2")
    kept = state.join(seen, "location", "left").select(
        "location",
        "lat",
        "lon",
        "first_frame",
        F.coalesce("_last", "last_frame").alias("last_frame"),
        (C("detection_count") + F.coalesce("_n", F.lit(0))).alias("detection_count"),
        F.when(larger, C("_a")).otherwise(C("area_m2")).alias("area_m2"),
        F.when(larger, C("_g")).otherwise(C("geometry_frame")).alias("geometry_frame"),
    )
    fresh = spatial.fold_locations(m.filter("place is null").drop("place"), radius_m)
    return kept.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))


def classify(new: DataFrame, state: DataFrame, radius_m: float) -> DataFrame:
    """Adds ``place`` and whether each detection is NEW or EXISTING."""
    m = spatial.first_within(new, state, radius_m)
    return m.withColumn("status", F.when(C("place").isNull(), "NEW").otherwise("EXISTING"))


def retract_frame(state: DataFrame, frame: int) -> DataFrame:
    """Drop what one frame contributed, for reprocessing."""
    return state.filter((C("geometry_frame") != frame) & (C("first_frame") != frame))


def write_version(state: DataFrame, path: str, version: int) -> None:
    """Versions are separate folders: readers keep the old one until the new one is complete."""
    state.write.mode("overwrite").parquet(f"{path}/version={version:06d}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version:06d}")


class Conflict(Exception):
    """Another writer has committed this version."""


class Versions:
    """A location set that several writers may change at once.

    A version is data in a folder of its own plus a commit file that names it. The commit file is created only if it is
    absent, which the file system decides for one writer; the other replays its change on the version that won. Readers
    follow commit files, so they never see half a version, and a task or driver lost before its commit leaves nothing
    but an unnamed folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit_file(self, version: int):
        return self._path(f"{self.folder}/commits/{version:09d}")

    def latest(self) -> int:
        """The newest committed version, or -1."""
        at = self._path(f"{self.folder}/commits")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()), default=-1) if self._fs.exists(at) else -1

    def read(self, version: int) -> DataFrame:
        stream = self._fs.open(self._commit_file(version))
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.folder}/data/{name}")

    def commit(self, state: DataFrame, version: int) -> int:
        """Writes ``state`` as ``version``; raises Conflict, and leaves no data, if that version exists."""
        name = uuid.uuid4().hex
        state.write.parquet(f"{self.folder}/data/{name}")
        try:
            stream = self._fs.create(self._commit_file(version), False)
        except Exception as e:  # py4j wraps the file system's exception
            self._fs.delete(self._path(f"{self.folder}/data/{name}"), True)
            if self._fs.exists(self._commit_file(version)):
                raise Conflict(version) from e
            raise
        stream.write(bytearray(name, "ascii"))
        stream.close()
        return version

    def change(self, step: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Commits ``step(newest state)``, again and again on what others committed meanwhile; returns the version.

        ``base`` is the version the caller has seen; the first try goes on top of it.
        """
        at = self.latest() if base is None else base
        while True:
            try:
                return self.commit(step(self.read(at)), at + 1)
            except Conflict:
                at = self.latest()


def reset(spark: SparkSession, path: str, version: int, stamp: str) -> DataFrame:
    """Snapshot the current version and start an empty one."""
    old = read_version(spark, path, version)
    old.write.mode("overwrite").parquet(f"{path}_backup/snapshot={stamp}")
    write_version(old.limit(0), path, version + 1)
    return read_version(spark, path, version + 1)


def unprocessed(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(done, keys, "left_anti")
