"""Distributed operators against brute force on small random inputs, with chunk sizes small enough to split."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from surveyspark.catalog import QUERIES
from surveyspark.functions import geo, rings
from surveyspark.operators import graph, ordered, raster, regions, spatial, state
from surveyspark.plans import segment


def rows(d, *cols):
    return sorted(tuple(r[c] for c in cols) for r in d.collect())


def test_index_and_neighbours_do_not_depend_on_chunks(spark):
    rnd = random.Random(1)
    data = [(g, f, rnd.randint(0, 99)) for g in "ab" for f in sorted(rnd.sample(range(500), 60))]
    d = spark.createDataFrame(data, "g string, frame int, v int")
    w = Window.partitionBy("g").orderBy("frame")
    want = d.select("g", "frame", (F.row_number().over(w) - 1).alias("idx"), F.avg("v").over(w.rowsBetween(-4, -1)).alias("a"), F.lead("v").over(w).alias("n"))
    got = ordered.neighbours(
        ordered.with_index(d, ["g"], "frame", chunk=16), ["g"],
        {"a": lambda w: F.avg("v").over(w.rowsBetween(-4, -1)), "n": lambda w: F.lead("v").over(w)}, before=4, after=1, chunk=7,
    )
    key = ("g", "frame", "idx")
    assert rows(got, *key) == rows(want, *key)
    pick = lambda x: {(r.g, r.frame): (r.a, r.n) for r in x.collect()}
    assert pick(got) == pick(want)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(size=700), np.full(400, 0.25)]  # a third of all rows is one value
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {round(r.p, 3): r["quantile"] for r in ordered.exact_quantiles(d, "v", [0.025, 0.5, 0.975], pivots=9).collect()}
    for p, q in got.items():
        assert q == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def brute_labels(cells, conn):
    out, todo = {}, set(cells)
    while todo:
        seed = min(todo)
        stack, seen = [seed], {seed}
        while stack:
            y, x = stack.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    n = (y + a, x + b)
                    if (conn == 8 or abs(a) + abs(b) == 1) and n in todo and n not in seen:
                        seen.add(n)
                        stack.append(n)
        for c in seen:
            out[c] = seed
        todo -= seen
    return out


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_match_flood_fill(spark, conn):
    rng = np.random.default_rng(conn)
    masks = [rng.random((13, 17)) < p for p in (0.2, 0.45, 0.6, 1.0)]
    data = [(f, int(y), int(x)) for f, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    d = spark.createDataFrame(data + data[:50], "frame int, y int, x int")  # repeats must not matter
    got = {(r.frame, r.y, r.x): r.region for r in regions.label_regions(d, ["frame"], 17, conn).collect()}
    for f, m in enumerate(masks):
        for (y, x), (sy, sx) in brute_labels(list(zip(*map(list, np.nonzero(m)))), conn).items():
            assert got[(f, y, x)] == sy * 17 + sx


def test_grid_labels_across_tiles(spark):
    rng = np.random.default_rng(9)
    m = rng.random((40, 40)) < 0.5
    cells = [(int(y) - 20, int(x) - 20) for y, x in zip(*np.nonzero(m))]
    d = spark.createDataFrame([(x, y) for y, x in cells], "gx long, gy long")
    got = {(r.gy, r.gx): r.region for r in regions.label_grid(d, [], tile=8).collect()}
    want = brute_labels(cells, 8)
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[c], want[c]) for c in cells}) == len(set(want.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    e = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5001)]
    d = spark.createDataFrame(e, "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(d).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1200)) and got[5001] == 5000


def sequential(points, radius):
    kept = []
    where = {}
    for o, la, lo in points:
        for k, kla, klo in kept:
            a = math.sin(math.radians(la - kla) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(kla)) * math.sin(math.radians(lo - klo) / 2) ** 2
            if 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) < radius:
                where[o] = k
                break
        else:
            kept.append((o, la, lo))
            where[o] = o
    return where


def clustered(n, seed):
    rnd = random.Random(seed)
    pts = [(i, -27.15 + rnd.random() * 4e-4, -109.44 + rnd.random() * 4e-4) for i in range(n)]
    hot = [(n + i, -27.1500001 - rnd.random() * 1e-5, -109.44 - rnd.random() * 1e-5) for i in range(n // 2)]  # one crowded spot
    track = [(2 * n + i, -27.16 + i * 3e-5, -109.44) for i in range(20)]  # a chain of mutually close arrivals
    return pts + hot + track


@pytest.mark.parametrize("seed,radius", [(1, 10.0), (2, 25.0)])
def test_fold_equals_sequential(spark, seed, radius):
    pts = clustered(200, seed)
    d = spark.createDataFrame(pts, "ord long, lat double, lon double")
    got = {r.ord: r.location for r in spatial.assign(d, radius).collect()}
    assert got == sequential(pts, radius)


def test_a_long_line_settles_in_few_rounds(spark, monkeypatch):
    """A flight line of 2,000 sightings 6 m apart, which a round of single steps would need 1,000 rounds for."""
    pts = [(i, -27.16 + i * 6 / 111195.0, -109.44) for i in range(2000)]
    d = spark.createDataFrame(pts, "ord long, lat double, lon double")
    rounds = []
    cut = spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda x: rounds.append(1) or cut(x))
    got = {r.ord for r in spatial.leaders(d, 10.0).collect()}
    assert got == set(sequential(pts, 10.0).values())
    assert (len(rounds) - 2) // 3 <= 10


def test_negative_radius_switches_folding_off(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "ord long, lat double, lon double")
    assert rows(spatial.assign(d, -1.0), "ord", "location") == [(1, 1), (2, 2)]


def test_grid_cells_of_a_concave_ring(spark):
    """A comb of three teeth; only cells are exchanged, not rings."""
    from surveyspark.catalog.spatials import grid_cells

    comb = [(0.0, 0.0), (9.3, 0.0), (9.1, 6.2), (7.4, 6.1), (7.2, 1.7), (5.3, 1.6), (5.1, 8.8), (4.2, 8.7), (3.9, 1.4), (1.8, 1.3), (1.5, 4.9), (0.2, 5.2), (0.0, 0.0)]
    ring = F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in comb])
    got = grid_cells(spark.range(2).select(ring.alias("ring")), [], 0.5, 0.0)
    cells = spark.range(400).select(F.expr("id div 20").alias("gx"), (F.col("id") % 20).alias("gy"))
    want = cells.filter(rings.contains(ring, (F.col("gx") + 0.5) * 0.5, (F.col("gy") + 0.5) * 0.5))
    assert rows(got, "gx", "gy") == rows(want, "gx", "gy")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_repeats_of_a_location_may_count(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0), (2, 2, 0.0, 0.0, 5.0)], "ord long, frame long, lat double, lon double, area_m2 double")
    cols = ["location", "detection_count", "area_m2", "geometry_frame"]
    assert rows(spatial.fold_hashed(d, 5.0, 1.13), *cols) == [(1, 1, 1.0, 1)]
    assert rows(spatial.fold_hashed(d, 5.0, 1.13, drop_repeats=False), *cols) == [(1, 2, 5.0, 2)]


def test_the_hash_query_keeps_larger_repeats(spark, tmp_path):
    """Positions repeat exactly after 4,161,200 events."""
    e = spark.createDataFrame([(3, 1, "purchase", 1.0), (3 + 4161200, 1, "purchase", 5.0)], "event_id long, user_id long, event_type string, value double")
    e.withColumns({"ts": F.current_timestamp(), "props": F.lit("{}")}).write.parquet(str(tmp_path / "events.parquet"))
    assert rows(QUERIES["dedup_hash_distance"](spark, str(tmp_path)), "location", "area_m2", "geometry_frame") == [(3, 5.0, 3 + 4161200)]


def test_upsert_equals_one_fold(spark):
    pts = [(o, o, la, lo, float(o * 37 % 11)) for o, la, lo in clustered(120, 5)]
    d = spark.createDataFrame(pts, "ord long, frame long, lat double, lon double, area_m2 double")
    cut = 150
    got = state.upsert(spatial.fold_locations(d.filter(F.col("ord") < cut), 10.0), d.filter(F.col("ord") >= cut), 10.0)
    want = spatial.fold_locations(d, 10.0)
    assert rows(got, *state.COLUMNS) == rows(want, *state.COLUMNS)


def test_merged_boxes(spark):
    rnd = random.Random(4)
    data = []
    for i in range(120):
        x, y, w, h = rnd.random(), rnd.random(), rnd.random() * 0.05, rnd.random() * 0.02
        data.append((x, x + w, y, y + h))
    data += [(5.0, 5.1, 5.0, 5.1)] * 60 + [(5.1, 5.2, 5.05, 5.06), (9.0, 9.0, 9.0, 9.0)]
    boxes = list(data)
    changed = True
    while changed:
        changed = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if a[0] <= b[1] and a[1] >= b[0] and a[2] <= b[3] and a[3] >= b[2]:
                    boxes[i] = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                    del boxes[j]
                    changed = True
                    break
            if changed:
                break
    d = spark.createDataFrame(data, "min_lon double, max_lon double, min_lat double, max_lat double")
    assert rows(spatial.merge_boxes(d), "min_lon", "max_lon", "min_lat", "max_lat") == sorted(boxes)


def test_containment_equals_brute_force(spark):
    rnd = random.Random(8)
    frames = [(i, rnd.random() * 0.004, rnd.random() * 0.004, rnd.choice([100, 300]), rnd.randint(0, 359)) for i in range(25)]
    pts = [(rnd.random() * 0.008 - 0.002, rnd.random() * 0.008 - 0.002) for _ in range(300)]
    f = spark.createDataFrame(frames, "frame int, lat double, lon double, altitude int, heading int")
    f = f.select(geo.footprint_corners(F.col("lat"), F.col("lon"), F.col("altitude"), F.col("heading")).alias("ring"))
    p = spark.createDataFrame(pts, "lat double, lon double")
    polys = [r.ring for r in f.collect()]

    def inside(ring, la, lo):
        c = False
        for a, b in zip(ring, ring[1:]):
            if (a.lat > la) != (b.lat > la) and lo < (b.lon - a.lon) * (la - a.lat) / (b.lat - a.lat) + a.lon:
                c = not c
        return c

    got = {(r.lat, r.lon): r.found for r in spatial.in_any_polygon(p, f).collect()}
    assert got == {(la, lo): any(inside(r, la, lo) for r in polys) for la, lo in pts}


def test_concave_rings_and_holes(spark):
    """Stars, rings within rings, open rings, equal rings, sides on cell borders, and shapes of very different sizes."""
    rng = random.Random(4)

    def star(cx, cy, r, n):
        a = sorted(rng.random() * 2 * math.pi for _ in range(n))
        p = [(cx + math.cos(t) * r * rng.uniform(0.2, 1), cy + math.sin(t) * r * rng.uniform(0.2, 1)) for t in a]
        return [*p, p[0]]

    def inside(shape, x, y):
        n = 0
        for r in shape:
            for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]]):
                n += min(y0, y1) <= y < max(y0, y1) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) < x
        return n % 2 == 1

    shapes = []
    for i in range(40):
        r, cx, cy = 10 ** rng.uniform(-4, -1.5), rng.uniform(-1, 1) * 0.05 - 109, rng.uniform(-1, 1) * 0.05 - 27
        ring = star(cx, cy, r, rng.randrange(3, 30))
        shapes.append((ring[:-1] if i % 5 == 0 else ring, [star(cx, cy, r * 0.3, 5)] if i % 3 == 0 else None))
    shapes += 2 * [([(-109.0, -27.0), (-108.99, -27.0), (-108.99, -26.99), (-109.0, -26.99), (-109.0, -27.0)], None)]
    pts = [(rng.uniform(-1, 1) * 0.08 - 27, rng.uniform(-1, 1) * 0.08 - 109) for _ in range(2000)]
    pts += [(y + rng.gauss(0, 1e-4), x + rng.gauss(0, 1e-4)) for ring, _ in shapes for x, y in rng.choices(ring, k=30)]
    point = "struct<lon: double, lat: double>"
    named = lambda ring: [{"lon": x, "lat": y} for x, y in ring]
    rows = [(named(r), h and [named(q) for q in h]) for r, h in shapes] + [(None, None), ([], None)]
    polygons = spark.createDataFrame(rows, f"ring array<{point}>, holes array<array<{point}>>")
    got = spatial.in_any_polygon(spark.createDataFrame([*pts, (None, 1.0)], "lat double, lon double"), polygons).collect()
    assert len(got) == len(pts) + 1 and not any(r.found for r in got if r.lat is None)
    assert 500 < sum(r.found for r in got) < len(pts) - 500
    assert all(r.found == any(inside([a, *(h or [])], r.lon, r.lat) for a, h in shapes) for r in got if r.lat is not None)


def test_points_along_the_rim_of_many_rings(spark, monkeypatch):
    """Cells where many points meet many rings are split until few pairs are left, without changing a result."""
    rnd = random.Random(3)
    crowds, crowded = [], spatial._crowded
    monkeypatch.setattr(spatial, "PAIRS", 8)
    monkeypatch.setattr(spatial, "_crowded", lambda a, b: crowds.append(crowded(a, b)) or crowds[-1])
    frames = [(rnd.random() * 1e-4 - 27, rnd.random() * 1e-4 - 109, 300, i) for i in range(360)] + [(None, -109.0, 300, 5)]
    f = spark.createDataFrame(frames, "lat double, lon double, altitude int, heading int")
    f = f.select(geo.footprint_corners(F.col("lat"), F.col("lon"), F.col("altitude"), F.col("heading")).alias("ring"))
    angles = [rnd.random() * 2 * math.pi for _ in range(600)]
    pts = [(-27 + 0.00145 * math.sin(a) + rnd.gauss(0, 5e-5), -109 + 0.00162 * math.cos(a) + rnd.gauss(0, 5e-5)) for a in angles]
    p = spark.createDataFrame(pts, "lat double, lon double")
    got = spatial.in_any_polygon(p, f)
    want = p.crossJoin(f).groupBy("lat", "lon").agg(F.max(rings.contains(F.col("ring"), F.col("lon"), F.col("lat"))).alias("found"))
    assert rows(got, "lat", "lon", "found") == rows(want, "lat", "lon", "found")
    assert 50 < got.filter("found").count() < 550
    assert len(crowds) > 2 and not crowds[0].isEmpty() and crowds[-1].isEmpty()


def test_training_rows_fill_every_core_once(spark):
    from surveyspark.operators import learn

    d = learn.dealt(spark.range(1000), "id")
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and d.count() == 1000


def test_distance_and_morphology(spark):
    rng = np.random.default_rng(2)
    m = rng.random((14, 19)) < 0.08
    data = [(0, int(y), int(x), bool(m[y, x])) for y in range(14) for x in range(19)]
    d = spark.createDataFrame(data, "frame int, y int, x int, t boolean")
    targets = np.argwhere(m)
    for r in raster.distance_to(d, "t", ["frame"]).collect():
        best = math.sqrt(min(((targets - [r.y, r.x]) ** 2).sum(axis=1)))
        assert r.distance == pytest.approx(best)
    mask = d.filter("t").select("frame", "y", "x")
    dil = set(rows(raster.dilate(mask, ["frame"], 3, 19, 14), "y", "x"))
    dense = set(rows(raster.dilate_dense(d, "t", ["frame"], 3, "o").filter("o"), "y", "x"))
    ero = set(rows(raster.erode(mask, ["frame"], 1, 19, 14), "y", "x"))
    assert dil == dense and ero <= set(rows(mask, "y", "x")) <= dil


def test_rotation_and_area_invariants(spark):
    d = spark.createDataFrame([(h,) for h in (0, 45, 90, 180, 270)], "h int")
    lat, lon, alt = F.lit(-27.15), F.lit(-109.44), F.lit(400.0)
    la, lo = geo.pixel_to_latlon(400, 200, lat, lon, alt, F.col("h"))
    got = {r.h: (r.a, r.o) for r in d.select("h", la.alias("a"), lo.alias("o")).collect()}
    assert got[0][0] > -27.15 and got[0][1] > -109.44  # up and right of the centre
    assert got[180][0] < -27.15 and got[180][1] < -109.44
    ring = rings.square(F.lit(-109.44), F.lit(-27.15), F.lit(1e-4))
    turned = F.concat(F.slice(ring, 2, 4), F.slice(ring, 2, 1))
    a, b = spark.range(1).select(rings.area_m2(ring), rings.area_m2(turned)).first()
    assert a == pytest.approx(b, rel=1e-5)


def test_variance_exactly_on_the_limit_is_land(spark):
    """The pixel's share of the variance range is 3/10 in whole numbers."""
    v = [37, 53, 16, 55, 37, 59, 43, 63, 49, 63, 34, 45, 66, 52, 40, 74, 44, 57, 35, 72, 43, 49, 40, 53, 48, 75, 37, 49, 52, 46, 44, 70, 40, 20, 47, 45, 37, 31, 54, 55, 47, 66, 42, 57, 52, 45, 37, 50, 59, 38, 69, 47, 45, 40, 30, 56, 57, 36, 67, 40, 61, 35, 38, 36]
    px = spark.createDataFrame([(0, i // 8, i % 8, 2900 + n) for i, n in enumerate(v)], "frame int, y int, x int, raw int")
    d = segment.by_temperature(px, ["frame"], "variance", 22.0, 8, 8)
    assert [r.land_mask for r in d.filter("y = 5 and x = 6").collect()] == [True]
    k = np.pad(np.array(v).reshape(8, 8), 2, "symmetric")
    n = np.array([[25 * (w * w).sum() - w.sum() ** 2 for x in range(8) for w in [k[y : y + 5, x : x + 5]]] for y in range(8)])
    assert 10 * (n[5, 6] - n.min()) == 3 * (n.max() - n.min())


def test_all_variances_on_the_limit_are_land(spark):
    """Shares of exactly 3/10 in frames where rounded ones fall short of it, and a frame without any range."""
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for f in range(3000):
        v = rng.integers(0, 6, (8, 8)) if f else np.full((8, 8), 3)
        k = np.lib.stride_tricks.sliding_window_view(np.pad(v, 2, "symmetric"), (5, 5)).reshape(8, 8, 25)
        n = 25 * (k * k).sum(2) - k.sum(2) ** 2
        on = 10 * (n - n.min()) - 3 * (n.max() - n.min())
        if (on == 0).any():
            rows += [(f, y, x, int(v[y, x]) + 2900) for y in range(8) for x in range(8)]
            want |= {(f, y, x) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(on >= 0)))}
    px = spark.createDataFrame(rows, "frame int, y int, x int, raw int")
    d = segment.by_temperature(px, ["frame"], "variance", 22.0, 8, 8)
    assert {(r.frame, r.y, r.x) for r in d.filter("land_mask").collect()} == want and len(want) > 64


def test_resampling_against_arrays(spark):
    """Non-integer ratios, both ways, against interpolation on whole arrays; a null needs all that touches it to be null."""
    rng = np.random.default_rng(6)
    for (h, w), (hh, ww) in (((5, 7), (8, 8)), ((8, 9), (3, 5)), ((1, 1), (2, 3))):
        a = rng.random((h, w)) * 100
        rows = [(0, y, x, float(a[y, x])) for y in range(h) for x in range(w)]
        got = raster.resample(spark.createDataFrame(rows, "frame int, y int, x int, v double"), ["v"], ["frame"], (h, w), (hh, ww)).collect()
        at = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        wide = np.stack([np.interp(at(w, ww), np.arange(w), r) for r in a])
        want = np.stack([np.interp(at(h, hh), np.arange(h), c) for c in wide.T], axis=1)
        assert len(got) == hh * ww and all(abs(r.v - want[r.y, r.x]) < 1e-9 for r in got)
    holed = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None), (0, 0, 2, 3.0), (0, 0, 3, 5.0)], "frame int, y int, x int, v double")
    got = raster.resample(holed, ["v"], ["frame"], (1, 4), (1, 2)).orderBy("x").collect()
    assert [r.v for r in got] == [None, 4.0]


def test_two_writers_lose_nothing(spark, tmp_path):
    """A writer that prepared its change on a version since replaced replays it; a failed commit leaves no data."""
    v = state.Versions(spark, str(tmp_path / "set"))
    d = lambda *rows: spark.createDataFrame(list(rows), "k int")
    assert v.latest() == -1
    assert v.commit(d((0,)), 0) == 0
    assert v.change(lambda now: now.union(d((1,))), 0) == 1
    tried = []
    assert v.change(lambda now: tried.append(now.count()) or now.union(d((2,))), 0) == 2
    assert tried == [1, 2]
    assert sorted(r.k for r in v.read(2).collect()) == [0, 1, 2] and v.latest() == 2
    with pytest.raises(state.Conflict):
        v.commit(d((9,)), 1)
    assert sorted(r.k for r in v.read(1).collect()) == [0, 1]
    assert len(list((tmp_path / "set" / "data").iterdir())) == 3


def test_a_worse_model_is_refused(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector
    from surveyspark.operators import learn

    d = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 4).cast("double").alias("target"), array_to_vector(F.array(F.col("id") % 4, F.col("id") * 0).cast("array<double>")).alias("features"))
    fits = [Pipeline(stages=[learn.forest(t, k)]).fit(d) for t, k in ((1, 1), (10, 4))]
    r = learn.Registry(spark, str(tmp_path))
    assert r.load() is None
    got = [r.upgrade(n, m, d)["promoted"] for n, m in (("small", fits[0]), ("large", fits[1]), ("small", fits[0]), ("large", fits[1]))]
    assert got == [True, True, False, False]
    assert [(e.version, e.model, e.rows) for e in r.entries().collect()] == [(1, "small", 200), (2, "large", 200)]
    assert learn.accuracy(r.load().transform(d)).first().accuracy == 1.0
    with pytest.raises(ValueError):
        learn.guard_samples(d.limit(39))
