"""Whole survey: detect, georeference, fold into unique locations, over any number of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions import geo, rings
from ..operators import glint as GL
from ..operators import regions, spatial
from ..operators.ordered import with_index
from ..session import cut_lineage
from . import detect as D

C = F.col
#: Frame numbers restart in every directory and directories repeat between surveys; only all three name a frame.
FRAME_KEY = ["survey", "media", "frame"]


def frame_key(d: DataFrame, frames: DataFrame) -> list[str]:
    """The part of the frame's identity that both tables carry; it is an error if one knows more than the other."""
    a, b = ([k for k in FRAME_KEY if k in x.columns] for x in (d, frames))
    if a != b or "frame" not in a:
        raise ValueError(f"frames are named by {a} and by {b}")
    return a


def georeference(plumes: DataFrame, frames: DataFrame, cfg: DetectConfig, default_altitude: float = 400.0) -> DataFrame:
    """Position and ground area of each plume; frames without GPS drop out."""
    key = frame_key(plumes, frames)
    gps = frames.filter("lat is not null and lon is not null").select(
        *key, "lat", "lon", F.coalesce("altitude", F.lit(default_altitude)).alias("altitude"), "heading", "ts"
    )
    d = plumes.join(gps, key)
    la, lo = geo.pixel_to_latlon(C("cx"), C("cy"), C("lat"), C("lon"), C("altitude"), C("heading"), cfg.camera)
    g = geo.gsd(C("altitude"), cfg.camera)
    return (
        d.withColumn("plat", la)
        .withColumn("plon", lo)
        .withColumn("area_m2", C("area") * g * g)
        .withColumn("area_px001_m2", C("area") * 0.01)
    )


def with_outline(plumes: DataFrame, labelled: DataFrame, frames: DataFrame, cfg: DetectConfig, keys: list[str]) -> DataFrame:
    """Attach the ground ring of each plume and its shoelace area."""
    ring = regions.outline(labelled, keys, cfg.camera.width)
    d = plumes.join(ring.withColumnRenamed("ring", "pixel_ring"), [*keys, "region"], "left")
    key = frame_key(plumes, frames)
    d = d.join(frames.select(*key, C("lat").alias("f_lat"), C("lon").alias("f_lon"), C("altitude").alias("f_alt"), C("heading").alias("f_head")), key)

    def to_ground(p):
        la, lo = geo.pixel_to_latlon(p["x"], p["y"], C("f_lat"), C("f_lon"), C("f_alt"), C("f_head"), cfg.camera)
        return geo.point(lo, la)

    return d.withColumn("ring", F.transform("pixel_ring", to_ground)).withColumn("ring_area_m2", rings.area_m2(C("ring"))).drop(
        "pixel_ring", "f_lat", "f_lon", "f_alt", "f_head"
    )


def arrivals(det: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``ord``, the dense place of each detection in the order of survey, directory, frame and region.

    Directories are numbered in their order (one small row each); inside one, positions come from counted key ranges.
    """
    group = [k for k in key if k != "frame"]
    if not group:
        return with_index(det, [], "frame", ["region"], out="ord")
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = det.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    d = with_index(det, group, "frame", ["region"], out="_in").join(starts, group)
    return d.withColumn("ord", C("_start") + C("_in")).drop("_start", "_in")


def run_survey(px: DataFrame, frames: DataFrame, cfg: DetectConfig, verdict: DataFrame | None = None, outlines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(detections, unique locations); surveys and directories are columns, so a campaign is the same call."""
    key = frame_key(px, frames)
    p = D.detect_edge(px, cfg, key) if cfg.window > 1 else D.detect(px, cfg, key)
    if verdict is not None:
        p = GL.veto(p, verdict, key)
    det = georeference(p, frames, cfg)
    if outlines:
        det = with_outline(det, D.labelled(px, cfg, key), frames, cfg, [*key, "threshold"])
    det = cut_lineage(arrivals(det, key))  # the fold reads it several times
    pts = det.select("ord", "frame", C("plat").alias("lat"), C("plon").alias("lon"), "area_m2", "anomaly")
    return det, spatial.fold_locations(pts, cfg.dedup_m, payload=["anomaly"])
