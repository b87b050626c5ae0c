"""Connected regions of a frame's mask and their properties.

A frame is bounded by its sensor, so its mask is gathered as a set of pixel positions (set semantics keep
the bound even if rows repeat) and labelled in one task; Spark distributes frames.  Masks that cross
frames (survey-wide grids) are labelled per tile and stitched by ``graph.connected_components``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.infrared import celsius
from .graph import connected_components
from .grids import joined


def _join_runs(width: int, connectivity: int):
    """Series of sorted position arrays -> per array the smallest position of each pixel's region, then its size."""

    def label(arrays: pd.Series) -> pd.Series:
        sizes = np.array([len(a) for a in arrays], dtype=np.int64)
        if sizes.sum() == 0:
            return pd.Series([np.empty(0, np.int64) for _ in sizes])
        pos = np.concatenate([np.asarray(a, dtype=np.int64) for a in arrays])
        region, area = joined(pos, np.repeat(np.arange(len(sizes)), sizes), width, connectivity)
        cuts = np.cumsum(sizes)[:-1]
        return pd.Series([np.r_[a, b] for a, b in zip(np.split(region, cuts), np.split(area, cuts))])

    return F.pandas_udf(label, T.ArrayType(T.LongType()))


def _labelled_arrays(mask: DataFrame, keys: list[str], width: int, connectivity: int, carry: list[str] = ()) -> DataFrame:
    """(keys, _s): one row per frame, its pixels with region and area."""
    pos = F.col("y").cast("long") * width + F.col("x")
    g = mask.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(pos.alias("pos"), *carry))).alias("_p"))
    lab = _join_runs(width, connectivity)
    g = g.select(*keys, "_p", lab(F.transform("_p", lambda s: s["pos"])).alias("_l"))
    n = F.size("_p")
    g = g.select(*keys, "_p", F.slice("_l", F.lit(1), n).alias("region"), F.slice("_l", n + 1, n).alias("area"))
    return g.select(*keys, F.arrays_zip("_p", "region", "area").alias("_s"))


def _pixels_of(arrays: DataFrame, keys: list[str], width: int, columns: list[str]) -> DataFrame:
    d = arrays.select(*keys, F.inline("_s"))
    pixel = [F.expr(f"cast(_p.pos div {width} as int)").alias("y"), F.expr(f"cast(_p.pos % {width} as int)").alias("x")]
    return d.select(*keys, *pixel, *[F.col(c) if c in ("region", "area") else F.col("_p")[c].alias(c) for c in columns])


def label_regions(
    mask: DataFrame, keys: list[str], width: int, connectivity: int = 8, carry: list[str] = ()
) -> DataFrame:
    """(keys, y, x, region, carry...) with region = smallest y * width + x of the connected set.

    Input already partitioned by (part of) the keys is grouped without an exchange.
    """
    return _pixels_of(_labelled_arrays(mask, keys, width, connectivity, carry), keys, width, ["region", *carry])


def label_grid(cells: DataFrame, group: list[str], tile: int = 512, connectivity: int = 8) -> DataFrame:
    """Regions of an unbounded integer grid (gx, gy): tile-local labels, then a graph over tile borders only.

    Adds ``region``, a struct-free long that is the same for all cells of one connected set.
    """
    t = cells.select(
        *group,
        F.floor(F.col("gx") / tile).alias("tx"),
        F.floor(F.col("gy") / tile).alias("ty"),
        F.pmod(F.col("gx"), F.lit(tile)).cast("int").alias("x"),
        F.pmod(F.col("gy"), F.lit(tile)).cast("int").alias("y"),
    )
    local = label_regions(t, [*group, "tx", "ty"], tile, connectivity)
    local = local.withColumn("node", F.xxhash64(*group, "tx", "ty", "region")).select(
        *group, (F.col("tx") * tile + F.col("x")).alias("gx"), (F.col("ty") * tile + F.col("y")).alias("gy"), "node", "x", "y"
    )
    edge = local.filter((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == tile - 1) | (F.col("y") == tile - 1))
    offs = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    moved = edge.select(
        *group,
        F.col("node").alias("src"),
        F.inline(F.array(*[F.struct((F.col("gx") + a).alias("gx"), (F.col("gy") + b).alias("gy")) for a, b in offs])),
    )
    links = (
        moved.join(edge.select(*group, "gx", "gy", F.col("node").alias("dst")), [*group, "gx", "gy"])
        .filter("src <> dst")
        .select("src", "dst")
        .distinct()
    )
    merged = connected_components(links)
    out = local.select(*group, "gx", "gy", "node").join(merged, "node", "left")
    return out.select(*group, "gx", "gy", F.coalesce("component", "node").alias("region"))


def region_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("area"))


def remove_small_objects(mask: DataFrame, keys: list[str], width: int, min_size: int, connectivity: int = 4) -> DataFrame:
    lab = _pixels_of(_labelled_arrays(mask, keys, width, connectivity), keys, width, ["area"])
    return lab.filter(F.col("area") >= min_size).drop("area")


def complement(mask: DataFrame, frames: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """All other positions of the given frames."""
    grid = frames.select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.join(mask, [*keys, "y", "x"], "left_anti")


def remove_small_holes(
    mask: DataFrame, frames: DataFrame, keys: list[str], width: int, height: int, area: int
) -> DataFrame:
    """Fill 4-connected background regions smaller than ``area``."""
    back = _labelled_arrays(complement(mask, frames, keys, width, height), keys, width, 4)
    holes = _pixels_of(back, keys, width, ["area"]).filter(F.col("area") < area).drop("area")
    return mask.select(*keys, "y", "x").unionByName(holes)


def largest_component(mask: DataFrame, keys: list[str], width: int, height: int, fraction: float = 0.05) -> DataFrame:
    """Pixels of the largest region if it covers more than ``fraction`` of the frame, else none."""
    lab = _labelled_arrays(mask, keys, width, 8)
    top = F.array_max(F.transform("_s", lambda e: F.struct(e["area"].alias("area"), (-e["region"]).alias("r"))))
    # The winner is a plain column below the explode: inside a lambda it would be worked out again per pixel.
    kept = lab.select(*keys, "_s", top.alias("_t")).filter(F.col("_t.area") > fraction * width * height)
    d = kept.select(*keys, "_s", (-F.col("_t.r")).alias("_best"))
    d = _pixels_of(d, [*keys, "_best"], width, ["region"])
    return d.filter(F.col("region") == F.col("_best")).drop("_best", "region")


def region_props(labelled: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Area, centroid, half-open bounding box, eccentricity and orientation from moment sums in one pass."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    s = labelled.groupBy(*keys, "region").agg(
        F.count(F.lit(1)).alias("area"),
        F.sum(y).alias("_sy"),
        F.sum(x).alias("_sx"),
        F.sum(y * y).alias("_syy"),
        F.sum(x * x).alias("_sxx"),
        F.sum(x * y).alias("_sxy"),
        F.min("y").alias("min_y"),
        F.min("x").alias("min_x"),
        (F.max("y") + 1).alias("max_y"),
        (F.max("x") + 1).alias("max_x"),
        *extra,
    )
    return region_shape(s, [*keys, "region"])


def region_shape(s: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid, eccentricity and orientation from the moment sums of each region; other columns stay."""
    n = F.col("area")
    cy, cx = F.col("_sy") / n, F.col("_sx") / n
    # Each pixel is a unit square: its own second moment is 1/12.
    vy = F.col("_syy") / n - cy * cy + F.lit(1 / 12)
    vx = F.col("_sxx") / n - cx * cx + F.lit(1 / 12)
    vxy = F.col("_sxy") / n - cx * cy
    root = F.sqrt((vx - vy) * (vx - vy) + vxy * vxy * 4)
    ratio = (vx + vy - root) / (vx + vy + root)
    return s.select(
        *keys,
        "area",
        cy.alias("cy"),
        cx.alias("cx"),
        "min_y",
        "min_x",
        "max_y",
        "max_x",
        F.sqrt(F.greatest(F.lit(1.0) - ratio, F.lit(0.0))).alias("eccentricity"),
        (F.atan2(vxy * 2, vx - vy) / 2).alias("orientation"),
        *[c for c in s.columns if c not in {*keys, "area", "min_y", "min_x", "max_y", "max_x"} and not c.startswith("_")],
    )


def temperature_columns() -> list[Column]:
    raw = F.col("raw")
    return [
        celsius(F.avg(raw)).alias("mean_temp"),
        celsius(F.min(raw)).alias("min_temp"),
        celsius(F.max(raw)).alias("max_temp"),
    ]


def edge_columns(width: int, height: int, buffer: int) -> list[Column]:
    """Whether a region comes within ``buffer`` pixels of each side."""
    y, x = F.col("y"), F.col("x")
    return [
        F.max(y < buffer).alias("touch_top"),
        F.max(y >= height - buffer).alias("touch_bottom"),
        F.max(x < buffer).alias("touch_left"),
        F.max(x >= width - buffer).alias("touch_right"),
    ]


def edges_touched() -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(f"touch_{s}"), s) for s in ("top", "bottom", "left", "right")])
    )


def outline(labelled: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Outer ring of each region through the midpoints between inside and outside pixels: (keys, region, ring).

    Boundary sides are found relationally; only the ring order of one region, bounded by the perimeter a
    frame allows, is walked inside a task.
    """
    k = [*keys, "region"]
    sides = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    near = [
        F.struct((F.col("y") + a).alias("ny"), (F.col("x") + b).alias("nx"), F.lit(i).alias("side"))
        for i, (a, b) in enumerate(sides)
    ]
    step = labelled.select(*k, "y", "x", F.inline(F.array(*near)))
    inner = labelled.select(*k, F.col("y").alias("ny"), F.col("x").alias("nx"))
    code = (F.col("y").cast("long") * width + F.col("x")) * 4 + F.col("side")
    border = step.join(inner, [*k, "ny", "nx"], "left_anti").groupBy(*k).agg(F.collect_set(code).alias("_sides"))
    flat = border.withColumn("_f", _rings(width)("_sides"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("_f") - 2, F.lit(2)),
        lambda i: F.struct(F.get("_f", i).alias("y"), F.get("_f", i + 1).alias("x")),
    )
    return flat.select(*k, pairs.alias("ring"))


def _rings(width: int):
    """Chain the unit sides of one region into rings; the one enclosing most, flattened to y0, x0, y1, x1, ..."""
    # Sides 0 top, 1 right, 2 bottom, 3 left, walked clockwise: corner where each begins, and its midpoint.
    corner = [(0, 0), (0, 1), (1, 1), (1, 0)]
    middle = [(-0.5, 0.0), (0.0, 0.5), (0.5, 0.0), (0.0, -0.5)]

    def ring_of(codes) -> list[float]:
        pending: dict[tuple, list] = {}
        for c in sorted(int(v) for v in codes):
            p, s = c // 4, c % 4
            y, x = p // width, p % width
            pending.setdefault((y + corner[s][0], x + corner[s][1]), []).append((y, x, s))
        best, best_area = [], -1.0
        while pending:
            at, ring, came = min(pending), [], None
            while at in pending:
                options = pending[at]
                # Where two pixels touch by a corner, turning left keeps both on the same ring.
                left = [i for i, o in enumerate(options) if came is not None and (came - o[2]) % 4 == 1]
                y, x, s = options.pop(left[0] if left else 0)
                if not options:
                    del pending[at]
                ring.append((y + middle[s][0], x + middle[s][1]))
                n = corner[(s + 1) % 4]
                at, came = (y + n[0], x + n[1]), s
            pts = np.array([*ring, ring[0]])
            area = abs(np.dot(pts[:-1, 0], pts[1:, 1]) - np.dot(pts[1:, 0], pts[:-1, 1])) / 2
            if area > best_area:
                best, best_area = pts.ravel().tolist(), area
        return best

    def rings(sides: pd.Series) -> pd.Series:
        return sides.map(ring_of)

    return F.pandas_udf(rings, T.ArrayType(T.DoubleType()))
