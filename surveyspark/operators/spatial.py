"""Distance joins, containment, and the unique-location set.

Cells are rows of latitude whose longitude step follows the cosine at that row, so a cell never exceeds
its nominal size.  Longitudes are taken as given (no wrap at 180 degrees).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, METRES_PER_DEGREE
from ..functions import geo, rings
from ..session import cut_lineage

C = F.col
M_PER_DEG = EARTH_RADIUS_M * math.pi / 180


def _row(lat: Column, size_m: float) -> Column:
    return F.floor(lat * F.lit(M_PER_DEG / size_m))


def _lon_step(row: Column, size_m: float) -> Column:
    """Degrees of longitude of a cell in this row, from the widest parallel it contains."""
    a, b = F.abs(row), F.abs(row + 1)
    return F.lit(size_m / M_PER_DEG) / F.cos(F.radians(F.least(a, b, F.lit(89.0 * M_PER_DEG / size_m)) * F.lit(size_m / M_PER_DEG)))


def cell(lat: Column, lon: Column, size_m: float) -> list[Column]:
    row = _row(lat, size_m)
    return [row.alias("cy"), F.floor(lon / _lon_step(row, size_m)).alias("cx")]


def reach(lat: Column, lon: Column, radius_m: float, size_m: float, stretch: float = 1.0) -> Column:
    """Cells within ``radius_m`` of a point as array<struct<cy,cx>>."""
    dlat = F.lit(radius_m * stretch * 1.001 / M_PER_DEG)
    dlon = dlat / F.cos(F.radians(F.abs(lat) + dlat))
    rows = F.sequence(_row(lat - dlat, size_m), _row(lat + dlat, size_m))

    def across(r: Column) -> Column:
        s = _lon_step(r, size_m)
        cols = F.sequence(F.floor((lon - dlon) / s), F.floor((lon + dlon) / s))
        return F.transform(cols, lambda c: F.struct(r.alias("cy"), c.alias("cx")))

    return F.flatten(F.transform(rows, across))


Metric = Callable[[Column, Column, Column, Column], Column]


def degree_metric(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Distance in degrees times metres per degree at the newer point's latitude."""
    dy, dx = lat - lat0, lon - lon0
    return F.sqrt(dy * dy + dx * dx) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))


def near_lists(places: DataFrame, radius_m: float, size_m: float, columns: list[str], stretch: float = 1.0) -> DataFrame:
    """Per cell the places that could be within reach: (cy, cx, near).

    Meant for location sets whose members keep their distance from one another, so a list is bounded by
    how many such points fit around a cell.
    """
    e = places.select(F.inline(reach(C("lat"), C("lon"), radius_m, size_m, stretch)), F.struct(*columns).alias("_p"))
    return e.groupBy("cy", "cx").agg(F.collect_list("_p").alias("near"))


def first_within(points: DataFrame, places: DataFrame, radius_m: float, metric: Metric = geo.haversine_m) -> DataFrame:
    """Adds ``place``: the earliest (by ``ord``) of the separated ``places`` strictly within the radius, else NULL.

    Points are joined once, by cell; candidates are tested inside the row, so nothing is multiplied.
    """
    near = near_lists(places, radius_m, radius_m, ["ord", "lat", "lon"])
    d = points.select("*", *cell(C("lat"), C("lon"), radius_m)).join(near, ["cy", "cx"], "left")
    hit = F.filter("near", lambda p: metric(C("lat"), C("lon"), p["lat"], p["lon"]) < radius_m)
    return d.withColumn("place", F.array_min(F.transform(hit, lambda p: p["ord"]))).drop("near", "cy", "cx")


def distance_join(points: DataFrame, places: DataFrame, radius_m: float, metric: Metric = geo.haversine_m) -> DataFrame:
    """Every (point, place) closer than the radius, ``places`` being a separated location set."""
    near = near_lists(places, radius_m, radius_m, ["ord", "lat", "lon"])
    d = points.select("*", *cell(C("lat"), C("lon"), radius_m)).join(near, ["cy", "cx"])
    pairs = F.transform(
        "near", lambda p: F.struct(p["ord"].alias("place"), metric(C("lat"), C("lon"), p["lat"], p["lon"]).alias("distance_m"))
    )
    return d.select(*points.columns, F.inline(F.filter(pairs, lambda p: p["distance_m"] < radius_m)))


#: Cells along one side of a tile, and the open points that may stand for a cell in a round.
TILE, FRONT = 256, 4


def _settle_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Front points of a tile that the first-come fold is sure to keep, in arrival order.

    Rows: front point, another in reach, whether that is earlier, whether it covers, whether it ends its cell's front
    (points behind it are unknown). One waits for whatever earlier point may yet be kept: an undecided or foreign one,
    or the unknown ones behind a covered end.
    """
    state: dict[int, str] = {}
    pdf = pdf.sort_values("ord", kind="stable")
    rows = zip(pdf["ord"].tolist(), pdf["other"].tolist(), pdf["earlier"].tolist(), pdf["hit"].tolist(), pdf["ends"].tolist())
    for ord_, group in itertools.groupby(rows, lambda r: r[0]):
        verdict = "kept"
        for _, other, earlier, hit, ends in group:
            if not earlier:
                continue
            was = state.get(other)
            if was == "kept" and hit:
                verdict = "covered"
                break
            if not (was == "kept" or was == "covered" and not ends):
                verdict = "open"
        state[ord_] = verdict
    return pd.DataFrame({"ord": [o for o, v in state.items() if v == "kept"]}, dtype="int64")


def leaders(points: DataFrame, radius_m: float, metric: Metric = geo.haversine_m, stretch: float = 1.0) -> DataFrame:
    """The locations a first-come fold would keep: (ord, lat, lon), ``ord`` a unique arrival number.

    A point is kept exactly when no kept earlier point lies within the radius.  Cells are small enough that
    any two points of a cell are within the radius, so at most one point per cell survives and a cell is
    represented by its few earliest open points (limited before the exchange, whatever the cell holds).  Each round folds
    these fronts of a tile in arrival order as far as they depend on nothing outside, then retires all points the
    kept ones cover, until none are open.  The earliest open point is always kept, so every round makes progress;
    rounds follow the number of tiles that a chain of mutually close arrivals runs through, not its points.
    """
    size = radius_m / math.sqrt(2) * 0.99 / stretch
    open_ = cut_lineage(points.select("ord", "lat", "lon", *cell(C("lat"), C("lon"), size)))
    kept = None
    while True:
        rank = F.row_number().over(Window.partitionBy("cy", "cx").orderBy("ord"))
        reps = open_.withColumn("k", rank).filter(C("k") <= FRONT + 1)
        more = F.max("k").over(Window.partitionBy("cy", "cx")) > FRONT
        reps = cut_lineage(reps.withColumn("ends", more & (C("k") == FRONT)).filter(C("k") <= FRONT).drop("k"))
        if reps.isEmpty():
            break
        ty = F.floor(C("cy") / TILE)  # one longitude step a row of tiles: columns of cells drift from row to row
        tile = [ty.alias("ty"), F.floor(C("lon") / (_lon_step(ty * TILE, size) * TILE)).alias("tx")]
        look = reps.select(*tile, "ord", "lat", "lon", F.inline(reach(C("lat"), C("lon"), radius_m, size, stretch)))
        other = reps.select("cy", "cx", C("ord").alias("other"), C("lat").alias("lat0"), C("lon").alias("lon0"), "ends")
        hit = metric(C("lat"), C("lon"), C("lat0"), C("lon0")) < radius_m
        pairs = look.join(other, ["cy", "cx"]).select("ty", "tx", "ord", "other", (C("other") < C("ord")).alias("earlier"), hit.alias("hit"), "ends")
        pairs = pairs.filter("earlier or other = ord")  # one's own row keeps those without an earlier one
        sure = pairs.groupBy("ty", "tx").applyInPandas(_settle_tile, "ord long")
        new = cut_lineage(reps.join(sure, "ord", "left_semi").select("ord", "lat", "lon"))
        kept = new if kept is None else kept.union(new)
        near = near_lists(new, radius_m, size, ["ord", "lat", "lon"], stretch)
        j = open_.join(near, ["cy", "cx"], "left")
        covered = F.exists("near", lambda p: (p["ord"] == C("ord")) | (metric(C("lat"), C("lon"), p["lat"], p["lon"]) < radius_m))
        open_ = cut_lineage(j.filter(~F.coalesce(covered, F.lit(False))).select("ord", "lat", "lon", "cy", "cx"))
    return kept if kept is not None else points.select("ord", "lat", "lon").limit(0)


def assign(points: DataFrame, radius_m: float, metric: Metric = geo.haversine_m, stretch: float = 1.0) -> DataFrame:
    """Adds ``location`` (arrival number of the location a point belongs to) and its position.

    Kept points belong to themselves; others to the earliest kept point within the radius, which is the
    first match of a list walked in arrival order.  A negative radius switches folding off.
    """
    own = F.struct("ord", "lat", "lon")
    if radius_m < 0:
        d = points.withColumn("_l", own)
    else:
        kept = leaders(points, radius_m, metric, stretch)
        size = radius_m * stretch
        near = near_lists(kept, radius_m, size, ["ord", "lat", "lon"], stretch)
        d = points.select("*", *cell(C("lat"), C("lon"), size)).join(near, ["cy", "cx"], "left")
        earlier = F.filter(
            "near", lambda p: (p["ord"] < C("ord")) & (metric(C("lat"), C("lon"), p["lat"], p["lon"]) < radius_m)
        )
        d = d.withColumn("_l", F.coalesce(F.array_min(earlier), own)).drop("near", "cy", "cx")
    return d.select(
        *points.columns, C("_l.ord").alias("location"), C("_l.lat").alias("location_lat"), C("_l.lon").alias("location_lon")
    )


def summarise(assigned: DataFrame, payload: list[str] = ()) -> DataFrame:
    """Unique locations: position of the first sighting, first/last frame, count, and geometry of the largest.

    Equal areas keep the earlier geometry, as a strict comparison in arrival order does.
    """
    largest = F.struct("area_m2", -C("ord"))
    return assigned.groupBy("location").agg(
        F.first("location_lat").alias("lat"),
        F.first("location_lon").alias("lon"),
        F.min_by("frame", "ord").alias("first_frame"),
        F.max_by("frame", "ord").alias("last_frame"),
        F.count(F.lit(1)).alias("detection_count"),
        F.max("area_m2").alias("area_m2"),
        F.max_by("frame", largest).alias("geometry_frame"),
        *[F.max_by(c, largest).alias(c) for c in payload],
    )


def fold_locations(points: DataFrame, radius_m: float, metric: Metric = geo.haversine_m, stretch: float = 1.0, payload: list[str] = ()) -> DataFrame:
    return summarise(assign(points, radius_m, metric, stretch), payload)


def fold_hashed(points: DataFrame, radius_m: float, stretch: float, digits: int = 6, drop_repeats: bool = True) -> DataFrame:
    """Fold by degree distance; an exact repeat of a kept location (same rounded key) is dropped outright.

    Without ``drop_repeats`` it folds like any other sighting and may bring a larger geometry.
    """
    a = assign(points, radius_m, degree_metric, stretch)
    if not drop_repeats:
        return summarise(a)
    same = (F.round("lat", digits) == F.round("location_lat", digits)) & (F.round("lon", digits) == F.round("location_lon", digits))
    return summarise(a.filter(~same | (C("ord") == C("location"))))


def distinct_rounded(points: DataFrame, digits: int = 5) -> DataFrame:
    """First arrival per rounded coordinate; a minimum, not a sort, so repeated places stay cheap."""
    key = [F.round("lat", digits).alias("klat"), F.round("lon", digits).alias("klon")]
    row = F.struct("ord", *[c for c in points.columns if c != "ord"])
    return points.groupBy(*key).agg(F.min_by(row, "ord").alias("_r")).select("_r.*")


# ---- containment -------------------------------------------------------------------------------


#: Cells along the longer side of a ring's box: between this and twice as many.
CELLS = 8


def _power(side: Column) -> Column:
    return F.floor(F.log2(F.greatest(side, F.lit(1e-9)))).cast("int")


def _grid(level: Column) -> Column:
    return F.pow(F.lit(2.0), level.cast("double"))


def _edges_of(ring: Column) -> Column:
    closed = F.concat(ring, F.slice(ring, 1, 1))
    n = F.size(ring)
    pair = lambda p, q: F.struct(p["lon"].alias("x0"), p["lat"].alias("y0"), q["lon"].alias("x1"), q["lat"].alias("y1"))
    return F.zip_with(F.slice(closed, F.lit(1), n), F.slice(closed, F.lit(2), n), pair)


_CELL = "k int, r long, c long"
_LOCAL = f"{_CELL}, edges array<struct<x0: double, y0: double, x1: double, y1: double>>, before int"
_SIDES = pa.list_(pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")]))


def _sides_of(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row and the ends of every edge of a batch."""
    flat, sizes = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("x0", "y0", "x1", "y1")}


def _at_height(e: dict[str, np.ndarray], y: np.ndarray) -> np.ndarray:
    """Where the edges have height ``y``."""
    return e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])


def _lists(e: dict[str, np.ndarray], at: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(e[n][at]) for n in e], list(e))).cast(_SIDES)


def _touched(k: np.ndarray, shape: np.ndarray, e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Cells that the edges of each shape touch, on a grid of its size class: shape, r, c of each cell, the edges crossing
    the row's middle line before it and in it, the edges by cell and their numbers."""
    g = np.ldexp(1.0, k)[shape]
    lo, hi = np.minimum(e["y0"], e["y1"]), np.maximum(e["y0"], e["y1"])
    row = np.floor(lo / g).astype(np.int64)
    n = np.floor(hi / g).astype(np.int64) - row + 1
    i = np.repeat(np.arange(len(n)), n)  # an edge in each of its rows
    r = row[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    d, g, lo, hi = {x: v[i] for x, v in e.items()}, g[i], lo[i], hi[i]
    flat, middle = lo == hi, (r + 0.5) * g
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = [np.where(flat, d[f"x{j}"], _at_height(d, y)) for j, y in enumerate((np.maximum(lo, r * g), np.minimum(hi, (r + 1) * g)))]
        crosses = (lo <= middle) & (middle < hi)
        m = np.floor(np.where(crosses, _at_height(d, middle), ends[0]) / g).astype(np.int64)
    a, z = (np.floor(x / g).astype(np.int64) for x in ends)
    first = np.minimum(np.minimum(a, z), m)
    n = np.maximum(np.maximum(a, z), m) - first + 1
    j = np.repeat(np.arange(len(n)), n)  # and in each cell of the row
    c = first[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
    s, r, edge, hit = shape[i][j], r[j], i[j], (crosses[j] & (c == m[j])).astype(np.int64)
    order = np.lexsort((c, r, s))
    s, r, c, edge, hit = s[order], r[order], c[order], edge[order], hit[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
    inside, sizes = np.add.reduceat(hit, new), np.diff(np.r_[new, len(s)])
    s, r, c = s[new], r[new], c[new]
    before = np.cumsum(inside) - inside
    start = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])]
    before -= before[start][np.cumsum(start) - 1]
    return s, r, c, before, inside, edge, sizes


def _walk(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Cells wholly inside a shape of the batch, or the touched cells of each shape with their edges and parity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            k = b.column("k").to_numpy()
            shape, e = _sides_of(b.column("edges"))
            s, r, c, before, inside, edge, sizes = _touched(k, shape, e)
            if whole:
                gap = np.flatnonzero((s[1:] == s[:-1]) & (r[1:] == r[:-1]) & (c[1:] > c[:-1] + 1) & ((before + inside)[:-1] % 2 == 1))
                n = c[gap + 1] - c[gap] - 1
                c = np.repeat(c[gap] + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                size, r = np.repeat(k[s[gap]], n), np.repeat(r[gap], n)
                order = np.lexsort((c, r, size))
                size, r, c = size[order], r[order], c[order]
                new = np.r_[True, (size[1:] != size[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])][:len(c)]
                yield pa.RecordBatch.from_arrays([pa.array(size[new], pa.int32()), pa.array(r[new]), pa.array(c[new])], ["k", "r", "c"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(k[s], pa.int32()), pa.array(r), pa.array(c), _lists(e, edge, sizes), pa.array(before, pa.int32())], ["k", "r", "c", "edges", "before"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, r, c, edges, before) of cells, dealt to the parts of each: the edges that come near a part, and the parity at
    the middle of its left side. A part that lies wholly inside or outside its shape has no edges."""
    n = 2**SPLIT
    i, j = np.divmod(np.arange(n * n), n)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            k, r, c = (b.column(x).to_numpy() for x in ("k", "r", "c"))
            row, e = _sides_of(b.column("edges"))
            left, middle, h = np.ldexp(c, k), np.ldexp(r + 0.5, k), np.ldexp(1.0, k - SPLIT)
            r, c = r[:, None] * n + i, c[:, None] * n + j
            x, y, slack = c * h[:, None], (r + 0.5) * h[:, None], h / 16  # more edges than needed do no harm
            s = {a: v[:, None] for a, v in e.items()}
            lo, hi = np.minimum(s["y0"], s["y1"]), np.maximum(s["y0"], s["y1"])
            west, lat, hair, size, side, height = x[row], y[row], slack[row][:, None], h[row][:, None], left[row][:, None], middle[row][:, None]
            south, north = lat - size / 2 - hair, lat + size / 2 + hair
            with np.errstate(divide="ignore", invalid="ignore"):
                ends = [np.where(lo == hi, s[f"x{a}"], _at_height(s, v)) for a, v in enumerate((np.maximum(lo, south), np.minimum(hi, north)))]
                near = (hi >= south) & (lo <= north) & (np.minimum(*ends) <= west + size + hair) & (np.maximum(*ends) >= west - hair)
                up = s["y0"] + (side - s["x0"]) * (s["y1"] - s["y0"]) / (s["x1"] - s["x0"])
                low, high = np.minimum(lat, height), np.maximum(lat, height)
                passed = (np.minimum(s["x0"], s["x1"]) < side) & (side <= np.maximum(s["x0"], s["x1"])) & (low <= up) & (up < high)
                across = _at_height(s, lat)
                passed = passed.astype(np.int64) + ((lo <= lat) & (lat < hi) & (side <= across) & (across < west))
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            parity = (b.column("before").to_numpy()[:, None] + np.add.reduceat(passed, first)) % 2
            sizes = np.add.reduceat(near.astype(np.int64), first)
            edge, part = np.nonzero(near)
            edge = edge[np.argsort(row[edge] * n * n + part, kind="stable")]
            every = pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(k - SPLIT, n * n), pa.int32()), pa.array(r.ravel()), pa.array(c.ravel()), _lists(e, edge, sizes.ravel()), pa.array(parity.ravel(), pa.int32())],
                ["k", "r", "c", "edges", "before"],
            )
            yield every.filter(pa.array(((sizes > 0) | (parity > 0)).ravel()))


def _leads_inside(lon: Column, lat: Column) -> Column:
    """Parity of a point in a crossed cell: that of the middle of the cell's left side, changed by each edge passed on the
    way up or down that side to the point's height and from there to the right. The way starts a hair left of the side, as
    the counts of the row do."""
    left, middle = C("left"), C("middle")
    low, high = F.least(lat, middle), F.greatest(lat, middle)

    def passes(e: Column) -> Column:
        y = e["y0"] + (left - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])
        side = (F.least(e["x0"], e["x1"]) < left) & (left <= F.greatest(e["x0"], e["x1"])) & (low <= y) & (y < high)
        x = e["x0"] + (lat - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
        across = (F.least(e["y0"], e["y1"]) <= lat) & (lat < F.greatest(e["y0"], e["y1"])) & (left <= x) & (x < lon)
        return F.when(side, 1).otherwise(0) + F.when(across, 1).otherwise(0)

    return F.aggregate("edges", C("before"), lambda n, e: n + passes(e)) % 2 == 1


#: Pairs of points and shapes that a cell may test; a fuller one is split, 2 ** SPLIT parts a side, down to the finest class.
PAIRS, SPLIT, FINEST = 1024, 2, -38


def _crowded(spots: DataFrame, local: DataFrame) -> DataFrame:
    """Keys of the cells with too many pairs to test."""
    key = ["k", "r", "c"]
    sizes = [d.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((spots, "_p"), (local, "_s"))]
    return sizes[0].join(sizes[1], key).filter((C("_p") * C("_s") > PAIRS) & (C("k") - SPLIT >= FINEST)).select(*key)


def in_any_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Adds ``found``: is the point (lat, lon) inside any shape of ``polygons(ring)``, by the even-odd rule?

    Rings may be concave or cross themselves; an optional column ``holes`` holds further rings of the same shape. Each
    shape lies on a grid of its own size class, so it touches a few dozen cells whatever its size. Along a row of
    cells, the number of edges that cross the row's middle line tells whether the next stretch of untouched cells is
    inside. Such cells answer for their points by a key lookup, however many shapes overlap there; only points in no
    such cell are tested, against the edges within their own cell alone. Where many points meet the edges of many shapes,
    along the rim of all, cells are first split into ever smaller ones, most of which lie inside one of the shapes or
    touch none. A point without a position is not found.
    """
    holes = [C("holes")] if "holes" in polygons.columns else []
    parts = F.concat(F.array(C("ring")), *[F.coalesce(h, F.array().cast(polygons.schema["holes"].dataType)) for h in holes])
    d = polygons.select("ring", *holes).distinct().select(F.flatten(F.transform(F.filter(parts, lambda r: r.isNotNull()), _edges_of)).alias("edges"))
    placed = lambda e: F.abs(e["x0"] + e["y0"] + e["x1"] + e["y1"]) < float("inf")
    d = d.withColumn("edges", F.filter("edges", placed))
    ends = lambda f, axis: f(F.transform("edges", lambda e: e[axis]))
    south, west = ends(F.array_min, "y0"), ends(F.array_min, "x0")
    side = F.greatest(ends(F.array_max, "x0") - west, ends(F.array_max, "y0") - south)
    d = d.filter(F.size("edges") > 0).select(_power(side / CELLS).alias("k"), "edges", south.alias("south"), west.alias("west"))
    cell = lambda c: F.floor(C(c) / _grid(C("k")))
    shapes = cut_lineage(d.select("k", "edges", cell("south").alias("r"), cell("west").alias("c")))
    levels = shapes.agg(F.array_sort(F.collect_set("k"))).scalar()
    spots = points.select("lat", "lon").filter("lat is not null and lon is not null").distinct().withColumn("k", F.explode(levels))
    spots = cut_lineage(spots.select("lat", "lon", "k", cell("lat").alias("r"), cell("lon").alias("c")))

    key = ["k", "r", "c"]
    whole = shapes.select("k", "edges").mapInArrow(lambda it: _walk(it, True), _CELL).distinct()
    sure = cut_lineage(spots.join(whole, key, "left_semi").select("lat", "lon").distinct())
    open_, few = cut_lineage(spots.join(sure, ["lat", "lon"], "left_anti")), None

    # A shape reaches up to 2 * CELLS cells beyond its first one; those whose blocks of cells hold no open point are out.
    block = lambda c: F.floor(C(c) / (2 * CELLS))
    near = open_.select(*key).distinct()
    back = F.sequence(F.lit(-2), F.lit(0))
    blocks = near.select("k", block("r").alias("r"), block("c").alias("c")).distinct().withColumn("i", F.explode(back)).withColumn("j", F.explode(back))
    blocks = blocks.select("k", (C("r") + C("i")).alias("_r"), (C("c") + C("j")).alias("_c")).distinct()
    reaching = shapes.withColumns({"_r": block("r"), "_c": block("c")}).join(blocks, ["k", "_r", "_c"], "left_semi").select("k", "edges")
    local = cut_lineage(reaching.mapInArrow(lambda it: _walk(it, False), _LOCAL).join(near, key, "left_semi"))
    while True:
        crowded = cut_lineage(_crowded(open_, local))
        calm = [d.join(crowded, key, "left_anti") for d in (open_, local)]
        few = calm if few is None else [a.union(b) for a, b in zip(few, calm)]
        if crowded.isEmpty():
            break
        parts = local.join(crowded, key, "left_semi").mapInArrow(_parts, _LOCAL)
        spots = open_.join(crowded, key, "left_semi").withColumn("k", C("k") - SPLIT)
        spots = spots.select("lat", "lon", "k", cell("lat").alias("r"), cell("lon").alias("c"))
        whole = parts.filter((F.size("edges") == 0) & (C("before") == 1)).select(*key).distinct()
        inside = cut_lineage(spots.join(whole, key, "left_semi").select("lat", "lon").distinct())
        sure, open_ = sure.union(inside), cut_lineage(spots.join(inside, ["lat", "lon"], "left_anti"))
        local = cut_lineage(parts.filter(F.size("edges") > 0).join(open_.select(*key).distinct(), key, "left_semi"))

    g = _grid(C("k"))
    spots, local = few[0].alias("o"), few[1].select("*", (C("c") * g).alias("left"), ((C("r") + 0.5) * g).alias("middle")).alias("l")
    same = (C("o.k") == C("l.k")) & (C("o.r") == C("l.r")) & (C("o.c") == C("l.c"))
    last = spots.join(local, same & _leads_inside(C("lon"), C("lat")), "left_semi")
    hits = sure.union(last.select("lat", "lon")).distinct().withColumn("found", F.lit(True))
    return points.join(hits, ["lat", "lon"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


# ---- boxes -------------------------------------------------------------------------------------

_BOX = ["min_lon", "max_lon", "min_lat", "max_lat"]


def _union_of(d: DataFrame, keys: list) -> DataFrame:
    return d.groupBy(*keys).agg(
        F.min("min_lon").alias("min_lon"),
        F.max("max_lon").alias("max_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lat").alias("max_lat"),
        F.sum("n").alias("n"),
    )


def merge_boxes(boxes: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Unions of overlapping boxes until none overlap: disjoint boxes with the number of inputs in each.

    Boxes are first thinned by key: those covering the same point of a grid no wider than themselves all
    overlap, so they collapse in one aggregation however many there are.  The remaining, spread-out boxes are
    matched through the cells of their own size class, each joins the smallest overlapping box, and the
    union is repeated because grown boxes may overlap anew.
    """
    d = boxes.select(*_BOX, F.lit(1).cast("long").alias("n"))
    for _ in range(max_rounds):
        lev = _power(F.least(C("max_lon") - C("min_lon"), C("max_lat") - C("min_lat")))
        g = _grid(C("_l"))
        d = d.withColumn("_l", lev)
        d = _union_of(d, ["_l", F.ceil(C("min_lon") / g).alias("_ax"), F.ceil(C("min_lat") / g).alias("_ay")])
        d = cut_lineage(d.select(*_BOX, "n").withColumn("id", F.monotonically_increasing_id()))
        links = overlapping_boxes(d, d.select("id", *_BOX)).filter("id <> other")
        low = cut_lineage(links.groupBy("id").agg(F.min("other").alias("m")))
        if low.isEmpty():
            return d.drop("id")
        j = d.join(low, "id", "left").withColumn("label", F.least("id", F.coalesce("m", "id")))
        d = _union_of(j, ["label"]).drop("label")
    raise RuntimeError("boxes did not settle")


def overlapping_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left columns..., other) for closed boxes that intersect, ``right`` being thinned or disjoint.

    Each box is written to the few cells of its own size class; the smaller of two partners looks up every
    larger class present, so sizes may differ freely.
    """
    top = _power(F.greatest(C("max_lon") - C("min_lon"), C("max_lat") - C("min_lat"))) + 1
    classes = right.select(top.alias("k")).union(left.select(top.alias("k"))).agg(F.array_sort(F.collect_set("k"))).scalar()

    def cells(k: Column) -> Column:
        g = _grid(k)
        xs = F.sequence(F.floor(C("min_lon") / g), F.floor(C("max_lon") / g))
        ys = F.sequence(F.floor(C("min_lat") / g), F.floor(C("max_lat") / g))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(k.alias("k"), x.alias("gx"), y.alias("gy")))))

    def spread(d: DataFrame, own_only: bool) -> DataFrame:
        d = d.withColumn("_k", top)
        if own_only:
            return d.select("*", F.inline(cells(C("_k")))).drop("_k")
        up = F.flatten(F.transform(F.filter(C("_all"), lambda k: k >= C("_k")), cells))
        return d.withColumn("_all", classes).select("*", F.inline(up)).drop("_k", "_all")

    names = [c for c in left.columns]
    meet = (
        (C("min_lon") <= C("o_max_lon")) & (C("max_lon") >= C("o_min_lon")) & (C("min_lat") <= C("o_max_lat")) & (C("max_lat") >= C("o_min_lat"))
    )
    key = ["k", "gx", "gy"]
    rr = right.select("id", *_BOX)

    def renamed(s: DataFrame) -> DataFrame:
        return s.select(*key, C("id").alias("other"), *[C(c).alias(f"o_{c}") for c in _BOX])

    a = spread(left, True).join(renamed(spread(rr, False)), key).filter(meet).select(*names, "other")
    b = spread(left, False).join(renamed(spread(rr, True)), key).filter(meet).select(*names, "other")
    return a.union(b).distinct()
