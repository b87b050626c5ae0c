"""Neighbourhood operators on pixel rows.

Dense operators expect the pixel table hash-partitioned by its frame (``pixels(colocate=keys)``); their
windows over (frame, y) and (frame, x) then need no exchange.  Masks are sparse: a missing row is false.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grids
from .grids import disk, squared_distance
from .regions import complement


def _shifted(mask: DataFrame, keys: list[str], offsets, width: int, height: int) -> DataFrame:
    hits = F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in offsets])
    d = mask.select(*keys, F.inline(hits))
    return d.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def dilate(mask: DataFrame, keys: list[str], r: int, width: int, height: int) -> DataFrame:
    """The distinct combines before the exchange, so about one row per result pixel travels."""
    return _shifted(mask, keys, disk(r), width, height).distinct()


def dilate_dense(px: DataFrame, column: str, keys: list[str], r: int, out: str) -> DataFrame:
    """The same as a boolean column of the full pixel table, by windows only.

    Each row of the disk is a running maximum along x; the rows are combined along y.
    """
    half = {a: max(b for c, b in disk(r) if c == a) for a in range(0, r + 1)}
    row, col = _line(keys, "x"), _line(keys, "y")
    d = px
    for k in sorted(set(half.values())):
        d = d.withColumn(f"_h{k}", F.max(column).over(row.rangeBetween(-k, k)))
    hit = F.col(f"_h{half[0]}")
    for a in range(1, r + 1):
        h = f"_h{half[a]}"
        hit = hit | F.coalesce(F.lag(h, a).over(col), F.lit(False)) | F.coalesce(F.lead(h, a).over(col), F.lit(False))
    return d.withColumn(out, hit).drop(*[f"_h{k}" for k in set(half.values())])


def erode(
    mask: DataFrame, keys: list[str], r: int, width: int, height: int, frames: DataFrame | None = None
) -> DataFrame:
    """Outside the frame counts as false, or as true when the frame list is given."""
    if frames is not None:
        outside = complement(mask, frames, keys, width, height)
        return mask.select(*keys, "y", "x").join(dilate(outside, keys, r, width, height), [*keys, "y", "x"], "left_anti")
    se = disk(r)
    d = _shifted(mask, keys, se, width, height).groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    return d.filter(F.col("_n") == len(se)).drop("_n")


def open_(mask, keys, r, width, height, frames=None) -> DataFrame:
    return dilate(erode(mask, keys, r, width, height, frames), keys, r, width, height)


def close(mask, keys, r, width, height, frames=None) -> DataFrame:
    return erode(dilate(mask, keys, r, width, height), keys, r, width, height, frames)


def shoreline(ocean: DataFrame, land: DataFrame, waves: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Ocean within two pixels of land, plus all waves."""
    c = [*keys, "y", "x"]
    near = dilate(land.select(*c), keys, 2, width, height).join(ocean.select(*c), c, "left_semi")
    return near.select(*c).union(waves.select(*c)).distinct()


def per_frame(px: DataFrame, keys: list[str], flags: list[str], made: list[str], make, shape: tuple[int, int] | None = None) -> DataFrame:
    """Adds boolean and distance columns that ``make(flag grids)`` derives from whole frames.

    A frame is gathered into one array, which its sensor bounds; only coordinates and flags go to Python, in one
    vectorised call a frame. ``shape`` (height, width) is the frame's; without it, its farthest pixels count. Rows already partitioned by ``keys`` stay where they are, before and after.
    """
    kinds = {n: "double" if n == "distance" else "boolean" for n in made}
    others = [c for c in px.columns if c not in keys]

    @F.pandas_udf("struct<" + ", ".join(f"{n}: array<{k}>" for n, k in kinds.items()) + ">")
    def whole(y: pd.Series, x: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        rows = []
        for y_, x_, *values in zip(y, x, *columns):
            grids = []
            for v in values:
                g = np.zeros(shape or (int(y_.max()) + 1, int(x_.max()) + 1), bool)
                g[y_, x_] = np.equal(v, True)
                grids.append(g)
            out = make(*grids)
            rows.append({n: v[y_, x_] if v.dtype == bool else np.where(v < 0, np.nan, np.sqrt(np.maximum(v, 0)))[y_, x_] for n, v in out.items()})
        return pd.DataFrame(rows, columns=made)

    d = px.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_p"))
    d = d.withColumn("_d", whole("_p.y", "_p.x", *[f"_p.{f}" for f in flags]))
    d = d.select(*keys, F.explode(F.arrays_zip(F.col("_p").alias("p"), *[F.col(f"_d.{n}").alias(n) for n in made])).alias("_e"))
    value = {n: F.nullif(F.col(f"_e.{n}"), F.lit(float("nan"))) if n == "distance" else F.col(f"_e.{n}") for n in made}
    return d.select(*[F.col(c) if c in keys else F.col(f"_e.p.{c}").alias(c) for c in px.columns], *[v.alias(n) for n, v in value.items()])


def distance_to(px: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Adds ``distance``, Euclidean and exact, to the nearest pixel where ``target`` holds; NULL in frames without one."""
    return per_frame(px, keys, [target], ["distance"], lambda t: {"distance": squared_distance(t)})


def shore_and_distance(px: DataFrame, keys: list[str], r: int = 2) -> DataFrame:
    """Adds ``shore`` (ocean within ``r`` of land, and all waves) and ``distance`` to it."""

    def make(land: np.ndarray, ocean: np.ndarray, waves: np.ndarray) -> dict[str, np.ndarray]:
        shore = grids.shore(land, ocean, waves, r)
        return {"shore": shore, "distance": squared_distance(shore)}

    return per_frame(px, keys, ["land", "ocean", "waves"], ["shore", "distance"], make)


def _mirrored(axis: str, size: int, r: int) -> Column:
    """Positions of a pixel in the padded line, reflecting about the outer pixel edges."""
    v = F.col(axis)
    reps = range(-(r // (2 * size) + 1), r // (2 * size) + 2)
    spots = F.array(*[s for k in reps for s in (v + 2 * size * k, F.lit(-1 + 2 * size * k) - v)])
    return F.filter(spots, lambda p: (p >= -r) & (p < size + r))


def _pad(d: DataFrame, axis: str, size: int, r: int) -> DataFrame:
    return d.withColumn(axis, F.explode(_mirrored(axis, size, r)))


def _line(keys: list[str], axis: str):
    other = "y" if axis == "x" else "x"
    return Window.partitionBy(*keys, other).orderBy(axis)


def box_sums(px: DataFrame, sums: dict[str, Column], keys: list[str], r: int, width: int, height: int, border: str = "reflect") -> DataFrame:
    """(keys, y, x, sums..., n) over the (2r+1)^2 window; 'reflect' mirrors the border, 'shrink' clips it."""
    d = px.select(*keys, "y", "x", *[c.alias(n) for n, c in sums.items()], F.lit(1).alias("n"))
    for axis, size in (("x", width), ("y", height)):
        if border == "reflect":
            d = _pad(d, axis, size, r)
        w = _line(keys, axis).rangeBetween(-r, r)
        d = d.select(*keys, "y", "x", *[F.sum(c).over(w).alias(c) for c in [*sums, "n"]])
        d = d.filter(F.col(axis).between(0, size - 1))
    return d


def box_filter(px, value: str, keys, r, width, height, border="reflect") -> DataFrame:
    d = box_sums(px, {"s": F.col(value)}, keys, r, width, height, border)
    return d.select(*keys, "y", "x", (F.col("s") / F.col("n")).alias("mean"))


def local_stats(px, value: str, keys, r, width, height, border="reflect", shift: float = 0.0) -> DataFrame:
    """Local mean and variance; ``shift`` keeps the squares small without changing the variance."""
    v = F.col(value) - F.lit(shift)
    d = box_sums(px, {"s": v, "ss": v * v}, keys, r, width, height, border)
    m = F.col("s") / F.col("n")
    return d.select(*keys, "y", "x", (m + F.lit(shift)).alias("mean"), F.greatest(F.col("ss") / F.col("n") - m * m, F.lit(0.0)).alias("variance"))


def sobel(px: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds gx, gy and magnitude; the border repeats the edge pixel."""

    def at(c: str, axis: str, k: int) -> Column:
        w = _line(keys, axis)
        return F.coalesce(F.lead(c, 1).over(w) if k > 0 else F.lag(c, 1).over(w), F.col(c))

    d = px.withColumn("_dx", at(value, "x", 1) - at(value, "x", -1)).withColumn("_sx", at(value, "x", 1) + at(value, "x", -1) + F.col(value) * 2)
    d = d.withColumn("gx", at("_dx", "y", 1) + at("_dx", "y", -1) + F.col("_dx") * 2).withColumn("gy", at("_sx", "y", 1) - at("_sx", "y", -1))
    return d.drop("_dx", "_sx").withColumn("magnitude", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")))


def central_difference(px: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds gradient_x and gradient_y: central inside, one-sided at the border."""
    for axis in ("x", "y"):
        w = _line(keys, axis)
        a, b = F.lag(value).over(w), F.lead(value).over(w)
        v = F.col(value)
        px = px.withColumn(
            f"gradient_{axis}",
            F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2).cast("double"),
        )
    return px


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def gaussian(px: DataFrame, value: str, keys: list[str], sigma: float, width: int, height: int) -> DataFrame:
    """Separable smoothing with a mirrored border: each axis is one padded window with fixed offsets."""
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    d = px.select(*keys, "y", "x", F.col(value).cast("double").alias("v"))
    for axis, size in (("x", width), ("y", height)):
        w = _line(keys, axis)
        d = _pad(d, axis, size, r)
        taps = [F.lag("v", -k).over(w) if k < 0 else F.lead("v", k).over(w) for k in range(-r, r + 1)]
        total = taps[0] * weights[0]
        for t, g in zip(taps[1:], weights[1:]):
            total = total + t * g
        d = d.select(*keys, "y", "x", total.alias("v")).filter(F.col(axis).between(0, size - 1))
    return d.withColumnRenamed("v", value)


def downsample(px: DataFrame, values: list[str], keys: list[str], k: int) -> DataFrame:
    """Block means; replaces interpolating resize."""
    by, bx = F.expr(f"cast(y div {k} as int)").alias("y"), F.expr(f"cast(x div {k} as int)").alias("x")
    return px.groupBy(*keys, by, bx).agg(*[F.avg(v).alias(v) for v in values])


def upsample_nearest(small: DataFrame, keys: list[str], k: int, width: int, height: int) -> DataFrame:
    rest = [c for c in small.columns if c not in {*keys, "y", "x"}]
    ys = F.explode(F.sequence(F.col("y") * k, F.least(F.col("y") * k + k - 1, F.lit(height - 1)))).alias("y")
    xs = F.explode(F.sequence(F.col("x") * k, F.least(F.col("x") * k + k - 1, F.lit(width - 1)))).alias("x")
    return small.select(*keys, ys, "x", *rest).select(*keys, "y", xs, *rest)


def _taps(size: int, wanted: int) -> list[tuple[int, int, float]]:
    """(target, source, weight): the two source pixels next to each target pixel's centre; the border repeats."""
    out = []
    for i in range(wanted):
        at = (i + 0.5) * size / wanted - 0.5
        low = int(np.floor(at))
        for source, weight in ((low, 1 - (at - low)), (low + 1, at - low)):
            if weight:
                out.append((i, min(max(source, 0), size - 1), weight))
    return out


def resample(px: DataFrame, values: list[str], keys: list[str], size: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """(keys, y, x, values) on another raster of (height, width), each pixel the bilinear mean of its four neighbours.

    One axis after the other, so a pixel has two taps at a time. The tap table has two rows a target line, whatever the
    number of frames; the sums stay where their frame is. Null values make the pixels that need them null.
    """
    d = px.select(*keys, "y", "x", *[F.col(v).cast("double").alias(v) for v in values])
    for axis, n, m in (("x", size[1], wanted[1]), ("y", size[0], wanted[0])):
        other = "y" if axis == "x" else "x"
        taps = px.sparkSession.createDataFrame(_taps(n, m), f"_t int, {axis} int, _w double")
        near = d.join(F.broadcast(taps), axis)  # bounded by the sensor
        sums = [F.when(F.count(v) == F.count(F.lit(1)), F.sum(F.col(v) * F.col("_w"))).alias(v) for v in values]
        d = near.groupBy(*keys, other, F.col("_t").alias(axis)).agg(*sums)
    return d.select(*keys, "y", "x", *values)


def patch_features(px: DataFrame, channels: dict[str, Column], keys: list[str], radius: int, margin: int, step: int, width: int, height: int) -> DataFrame:
    """mean, std, min, max of every channel in the window around each grid point.

    A pixel is sent to the few grid points whose window holds it, so the table is grouped once.
    """

    def points(axis: str, size: int) -> Column:
        lo = F.greatest(F.ceil((F.col(axis) - radius - margin) / step), F.lit(0)).cast("int")
        hi = F.floor((F.col(axis) + radius - margin) / step).cast("int")
        hi = F.least(hi, F.lit((size - 2 * margin - 1) // step))
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: i * step + margin))

    d = px.select(*keys, "y", "x", *[c.cast("double").alias(n) for n, c in channels.items()])
    d = d.select(*keys, F.explode(points("y", height)).alias("py"), "x", *channels)
    d = d.select(*keys, "py", F.explode(points("x", width)).alias("px"), *channels)
    stats = []
    for n in channels:
        stats += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"), F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max")]
    return d.groupBy(*keys, "py", "px").agg(*stats)


def fill_undefined(ocean: DataFrame, land: DataFrame, undefined: DataFrame, keys: list[str], r: int, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Undefined pixels near only one of the two classes join that class."""
    c = [*keys, "y", "x"]
    near_o, near_l = dilate(ocean, keys, r, width, height), dilate(land, keys, r, width, height)
    u = undefined.select(*c)
    to_ocean = u.join(near_o, c, "left_semi").join(near_l, c, "left_anti")
    to_land = u.join(near_l, c, "left_semi").join(near_o, c, "left_anti")
    return ocean.select(*c).union(to_ocean), land.select(*c).union(to_land)


def local_adaptive(px, value: str, keys, r, width, height, k: float = 1.5, shift: float = 0.0) -> DataFrame:
    """Pixels more than k local standard deviations below the local mean."""
    s = local_stats(px, value, keys, r, width, height, "shrink", shift)
    return px.join(s, [*keys, "y", "x"]).filter(F.col(value) < F.col("mean") - F.sqrt("variance") * k)
