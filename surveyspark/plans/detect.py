"""Cold-plume detection.

Pixel tables ``px`` carry (keys, y, x, raw, ocean, land, waves). Detection itself runs on frame tables: one row a
frame with its pixels as arrays. Shoreline, distance and labelling are vectorised on the whole frame, and only the sums
of cold regions (or, for outlines, their pixels) become rows; shapes and limits are expressions on them. Frames partitioned
by their keys stay where they are; only histograms move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions.infrared import celsius
from ..operators import baseline as B
from ..operators import grids, raster, regions

C = F.col
KEYS = ["media", "frame"]


def with_waves(px: DataFrame, cfg: DetectConfig) -> DataFrame:
    return px.withColumn("ocean", C("ocean") | C("waves")) if cfg.include_waves else px


def ocean_share(px: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return px.groupBy(*keys).agg(F.avg(C("ocean").cast("int")).alias("ocean_fraction"))


def guard(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    """Frames with hardly any ocean yield nothing."""
    seen = ocean_share(px, keys).filter(C("ocean_fraction") >= cfg.min_ocean_fraction)
    return px.join(seen.select(*keys), keys, "left_semi")


def with_shore(px: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds ``shore`` and the pixel distance to it, without a limit (NULL only in frames that have no shore)."""
    return raster.shore_and_distance(px, keys)


def baselines(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    h = B.temp_hist(px, keys)
    if cfg.window > 1:
        return B.moving_baseline(h, [k for k in keys if k != "frame"], cfg.window, cfg.baseline)
    return B.BASELINES[cfg.baseline](h, keys)


def raw_level(celsius_col: Column) -> Column:
    """Back to raw counts, so comparisons are not at the mercy of the last bit."""
    return F.round((celsius_col + 273.15) * 10, 6)


def cold_pixels(px: DataFrame, base: DataFrame | None, thresholds: list[float], keys: list[str] = KEYS) -> DataFrame:
    """Ocean pixels below baseline - threshold; one row per threshold they pass, pixels read once.

    Without ``base`` the pixels carry their ``baseline`` already.
    """
    j = px.filter("ocean")
    j = j if base is None else j.join(base, keys)
    level = raw_level(C("baseline"))
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: C("raw") < level - t * 10)
    return j.withColumn("threshold", F.explode(passed))


def frames_of(px: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, raw, surface): one row a frame, its pixels' coordinates, counts and surface bits (1 ocean, 2 land,
    4 waves) as arrays. Pixels already partitioned by the keys are gathered where they are."""
    bit = lambda c, n: F.when(C(c), n).otherwise(0)
    surface = (bit("ocean", 1) + bit("land", 2) + bit("waves", 4)).cast("tinyint")
    p = px.groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "raw", surface.alias("surface"))).alias("_p"))
    return p.select(*keys, *[C(f"_p.{c}").alias(c) for c in ("y", "x", "raw", "surface")])


def _counts(batches: Iterator[pa.RecordBatch], keys: list[str], wanted: int, least: float) -> Iterator[pa.RecordBatch]:
    """Histogram of each frame's ocean, unless the share of ocean among its pixels is below ``least``."""
    for b in batches:
        for i in range(b.num_rows):
            raw, surface = (b.column(c)[i].values.to_numpy() for c in ("raw", "surface"))
            seen = raw[(surface & wanted) > 0]
            if not len(seen) or len(seen) < least * len(raw):
                continue
            base = seen.min()
            if seen.max() - base < 1 << 20:
                n = np.bincount(seen - base)
                v = np.flatnonzero(n)
                v, n = (v + base).astype(np.int32), n[v]
            else:
                v, n = np.unique(seen, return_counts=True)
            same = pa.array(np.full(len(v), i))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(same) for k in keys), pa.array(v), pa.array(n)], [*keys, "raw", "n"])


def histograms(frames: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    """(keys, raw, n) of the frames' ocean; frames with hardly any ocean are left out."""
    schema = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    wanted, least = 5 if cfg.include_waves else 1, cfg.min_ocean_fraction
    return frames.select(*keys, "raw", "surface").mapInArrow(lambda it: _counts(it, keys, wanted, least), f"{schema}, raw int, n long")


def frame_baselines(frames: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    h = histograms(frames, cfg, keys)
    if cfg.window > 1:
        return B.moving_baseline(h, [k for k in keys if k != "frame"], cfg.window, cfg.baseline)
    return B.BASELINES[cfg.baseline](h, keys)


#: What a region leaves: moment sums, extent, sums and extremes of counts, least and mean distance to the shore.
_LONGS = ["region", "area", "_sy", "_sx", "_syy", "_sxx", "_sxy", "min_y", "min_x", "max_y", "max_x", "_raw", "_low", "_high"]
_SUMS = {**dict.fromkeys(_LONGS, "long"), "min_shore": "double", "mean_shore": "double"}
_PIXELS = {"y": "int", "x": "int", "raw": "int", "region": "long", "distance": "double"}


def _cold(
    batches: Iterator[pa.RecordBatch], keys: list[str], thresholds: list[float], include_waves: bool, connectivity: int, shape: tuple[int, int], as_pixels: bool, least: float
) -> Iterator[pa.RecordBatch]:
    """The cold regions of each frame at each threshold, as sums or as their pixels with region (its smallest position)
    and distance to the shore; distances are NULL in frames without a shore."""
    columns = _PIXELS if as_pixels else _SUMS
    for b in batches:
        for i in range(b.num_rows):
            y, x, raw, surface = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("y", "x", "raw", "surface"))
            counts, bits = np.zeros(shape, np.int32), np.zeros(shape, np.int8)
            counts[y, x], bits[y, x] = raw, surface
            ocean, land, waves = ((bits & bit) > 0 for bit in (1, 2, 4))
            ocean = ocean | waves if include_waves else ocean
            if np.count_nonzero(ocean) < least * len(raw):
                continue
            level = b.column("_level")[i].as_py()
            masks = [ocean & (counts < level - t * 10) for t in thresholds]
            any_ = np.logical_or.reduce(masks)
            distance = np.full(shape, np.nan)
            if any_.any():
                d2 = grids.squared_distance(grids.shore(land, ocean, waves), any_)[any_]
                distance[any_] = np.where(d2 < 0, np.nan, np.sqrt(np.maximum(d2, 0)))
            for t, m in zip(thresholds, masks):
                if as_pixels:
                    pos, region, _ = grids.regions(m, connectivity)
                    found = {"y": pos // shape[1], "x": pos % shape[1], "raw": counts.ravel()[pos], "region": region, "distance": distance.ravel()[pos]}
                else:
                    found = grids.region_sums(m, counts, distance, connectivity)
                if found and (n := len(found["region"])):
                    same = pa.array(np.full(n, i))
                    made = [pa.array(found[c].astype({"int": np.int32, "long": np.int64, "double": float}[k]), from_pandas=True) for c, k in columns.items()]
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(same) for k in [*keys, "baseline"]), pa.array(np.full(n, float(t))), *made], [*keys, "baseline", "threshold", *columns])


def cold_regions(
    frames: DataFrame, cfg: DetectConfig, thresholds: list[float] | None = None, keys: list[str] = KEYS, connectivity: int = 8, as_pixels: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """(keys, baseline, threshold, sums of each cold region), or the pixels of these regions: no others become rows.

    ``base`` (keys, baseline) spares the histograms where baselines are known."""
    thresholds, shape = thresholds or [cfg.threshold], (cfg.camera.height, cfg.camera.width)
    j = frames.join(frame_baselines(frames, cfg, keys) if base is None else base, keys).withColumn("_level", raw_level(C("baseline")))
    j = j.select(*keys, "baseline", "_level", "y", "x", "raw", "surface")
    kinds = {k: j.schema[k].dataType.simpleString() for k in keys} | {"baseline": "double", "threshold": "double"} | (_PIXELS if as_pixels else _SUMS)
    return j.mapInArrow(
        lambda it: _cold(it, keys, thresholds, cfg.include_waves, connectivity, shape, as_pixels, cfg.min_ocean_fraction), ", ".join(f"{k} {v}" for k, v in kinds.items())
    )


def measure(sums: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    """Geometry, temperatures, anomaly, shore distance and touched edges of cold regions."""
    w, h, edge = cfg.camera.width, cfg.camera.height, cfg.edge_buffer
    touch = {"top": C("min_y") < edge, "bottom": C("max_y") > h - edge, "left": C("min_x") < edge, "right": C("max_x") > w - edge}
    s = sums.select(
        "*", celsius(C("_raw") / C("area")).alias("mean_temp"), celsius(C("_low")).alias("min_temp"), celsius(C("_high")).alias("max_temp"),
        *[c.alias(f"touch_{n}") for n, c in touch.items()],
    )
    return regions.region_shape(s, [*keys, "threshold", "region"]).withColumn("anomaly", C("mean_temp") - C("baseline"))


def accept(p: DataFrame, cfg: DetectConfig) -> DataFrame:
    keep = (C("min_shore") < cfg.max_shore) & (C("area") >= cfg.min_area)
    if cfg.max_area is not None:
        keep = keep & (C("area") <= cfg.max_area)
    return p.filter(keep)


def is_edge() -> Column:
    return C("touch_top") | C("touch_bottom") | C("touch_left") | C("touch_right")


def accept_edge(p: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Regions cut by the frame edge pass with half the area and a wider shore limit."""
    inner = (C("min_shore") < cfg.max_shore) & (C("area") >= cfg.min_area)
    if cfg.max_area is not None:
        inner = inner & (C("area") <= cfg.max_area)
    edge = (C("min_shore") < cfg.edge_shore) & (C("area") >= max(1, cfg.min_area // 2))
    return p.withColumn("is_edge", is_edge()).filter(F.when(C("is_edge"), edge).otherwise(inner))


def labelled(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS, connectivity: int = 8) -> DataFrame:
    """Pixels of the cold regions with their region number, for outlines."""
    return cold_regions(frames_of(px, keys), cfg if cfg.window > 1 else replace(cfg, window=0), None, keys, connectivity, True)


def regions_of(px: DataFrame, cfg: DetectConfig, thresholds: list[float] | None = None, keys: list[str] = KEYS) -> DataFrame:
    return measure(cold_regions(frames_of(px, keys), cfg, thresholds, keys), cfg, keys)


def detect_frames(frames: DataFrame, cfg: DetectConfig, thresholds: list[float] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Accepted plumes of a frame table, at one or more thresholds."""
    return accept(measure(cold_regions(frames, cfg, thresholds, keys), cfg, keys), cfg)


def detect(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS, base: DataFrame | None = None) -> DataFrame:
    """Single-frame baseline."""
    return accept(measure(cold_regions(frames_of(px, keys), replace(cfg, window=0), None, keys, base=base), cfg, keys), cfg)


def detect_moving(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    return accept(regions_of(px, cfg, keys=keys), cfg)


def detect_edge(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS) -> DataFrame:
    return accept_edge(regions_of(px, cfg, keys=keys), cfg)


def detect_thresholds(px: DataFrame, cfg: DetectConfig, thresholds: list[float], keys: list[str] = KEYS) -> DataFrame:
    return accept(regions_of(px, replace(cfg, window=0), thresholds, keys), cfg)


def frame_characteristics(p: DataFrame, keys: list[str] = KEYS, m2_per_px: float = 0.01) -> DataFrame:
    """Union of a frame's accepted plumes."""
    w = F.sum(C("mean_temp") * C("area")) / F.sum("area")
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_plumes"),
        F.sum("area").alias("area_px"),
        (F.sum("area") * F.lit(m2_per_px)).alias("area_m2"),
        w.alias("mean_temp"),
        F.min("min_temp").alias("min_temp"),
        F.max("max_temp").alias("max_temp"),
        (w - F.first("baseline")).alias("anomaly"),
    )


def zscore_cold(px: DataFrame, keys: list[str] = KEYS, z: float = -1.5) -> DataFrame:
    o = px.filter("ocean")
    s = o.groupBy(*keys).agg(F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"))
    return o.join(s, keys).filter((C("raw") - C("_m")) / (C("_s") + F.lit(1e-7)) < z).select(*keys, "y", "x")


def zscore_detect(px: DataFrame, cfg: DetectConfig, min_size: int = 20, keys: list[str] = KEYS, z: float = -1.5) -> DataFrame:
    """Cold by z-score, opened and closed by a cross, 4-connected regions."""
    w, h = cfg.camera.width, cfg.camera.height
    m = raster.close(raster.open_(zscore_cold(px, keys, z), keys, 1, w, h), keys, 1, w, h)
    lab = regions.label_regions(m, keys, w, 4)
    return regions.region_sizes(lab, keys).filter(C("area") >= min_size)


def confidence(px: DataFrame, cfg: DetectConfig, keys: list[str] = KEYS, sigma: float = 2.0) -> DataFrame:
    """Anomaly share times exp(-distance/20) on cold pixels, smoothed."""
    base = B.percentile_baseline(B.temp_hist(px, keys), keys, 0.5)
    d = with_shore(px, keys).join(base, keys)
    level = raw_level(C("baseline"))
    drop = F.when(C("ocean"), F.greatest(level - C("raw"), F.lit(0.0))).otherwise(F.lit(0.0))
    top = d.withColumn("_drop", drop).groupBy(*keys).agg(F.max("_drop").alias("_top"))
    cold = C("ocean") & (C("raw") < level - cfg.threshold * 10)
    v = F.when(cold, drop / F.nullif(C("_top"), F.lit(0.0)) * F.coalesce(F.exp(-C("distance") / 20), F.lit(0.0))).otherwise(F.lit(0.0))
    return raster.gaussian(d.join(top, keys).withColumn("confidence", v), "confidence", keys, sigma, cfg.camera.width, cfg.camera.height)


def composite(flags: DataFrame, n_frames: DataFrame, group: list[str]) -> DataFrame:
    """How often each pixel position is cold, and its mean confidence over all frames of the group."""
    s = flags.groupBy(*group, "y", "x").agg(F.sum(C("hit").cast("int")).alias("frequency"), F.sum("confidence").alias("_c"))
    j = s.join(n_frames, group)
    return j.select(
        *group, "y", "x", "frequency", (C("frequency") / C("n_frames")).alias("persistence"), (C("_c") / C("n_frames")).alias("mean_confidence")
    )
