"""Array kernels of one frame against plain brute force, and full-size scenes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.config import DetectConfig
from surveyspark.operators import grids
from surveyspark.plans import detect, segment


def flood(mask, connectivity):
    """Regions as lists of pixels, by walking."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (connectivity == 8 or a * b == 0)]
    left, out = set(zip(*map(np.ndarray.tolist, np.nonzero(mask)))), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            for a, b in near:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        out.append(sorted(seen))
    return sorted(out)


def test_distance_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        h, w = rng.integers(1, 30, 2)
        m = rng.random((h, w)) < rng.choice([0.01, 0.1, 0.5])
        m[rng.integers(h), rng.integers(w)] = True
        y, x = np.nonzero(m)
        rows, cols = np.mgrid[:h, :w]
        want = ((rows[..., None] - y) ** 2 + (cols[..., None] - x) ** 2).min(-1)
        wanted = rng.random((h, w)) < 0.1
        assert (grids.squared_distance(m) == want).all() and (grids.squared_distance(m, steps=0) == want).all()
        assert (grids.squared_distance(m, wanted)[wanted] == want[wanted]).all()
    assert (grids.squared_distance(np.zeros((3, 4), bool)) == -1).all()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions_and_their_sums(connectivity):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.2, 0.5, 0.7, 1.0):
        m, v, d = rng.random((17, 23)) < share, rng.integers(0, 4000, (17, 23)), rng.random((17, 23))
        want = flood(m, connectivity)
        pos, region, area = grids.regions(m, connectivity)
        assert [(p, r, a) for p, r, a in zip(pos, region, area)] == sorted((y * 23 + x, g[0][0] * 23 + g[0][1], len(g)) for g in want for y, x in g)
        s = grids.region_sums(m, v, d, connectivity)
        if want:
            assert s["region"].tolist() == [g[0][0] * 23 + g[0][1] for g in want] and s["area"].tolist() == [len(g) for g in want]
            assert s["_sxy"].tolist() == [sum(y * x for y, x in g) for g in want] and s["max_x"].tolist() == [max(x for _, x in g) + 1 for g in want]
            assert s["_raw"].tolist() == [int(sum(v[p] for p in g)) for g in want] and np.allclose(s["mean_shore"], [np.mean([d[p] for p in g]) for g in want])
        big = np.zeros(m.shape, bool)
        for g in want:
            if len(g) >= 4:
                big[tuple(zip(*g))] = True
        assert (grids.drop_small(m, 4, connectivity) == big).all() and (grids.fill_small(~m, 4, connectivity) == ~big).all()


def test_borders_of_growing_and_shrinking():
    m = np.zeros((9, 9), bool)
    m[:, :4] = True
    assert (grids.erode(m, 2)[:, :2]).all() and not grids.erode(m, 2)[:, 2:].any()
    assert (grids.close(m, 2) == m).all() and (grids.open_(m, 1) == m).all()


def scene():
    """Sea with a lagoon too small to count, specks of land, foam and dark holes."""
    rgb = np.zeros((512, 640, 3), np.int32)
    rgb[:] = (120, 140, 60)  # land
    rgb[150:, :] = (20, 60, 150)  # sea
    rgb[20:40, 20:40] = (20, 60, 150)  # lagoon of 400 pixels
    rgb[300:309, 300:309] = (120, 140, 60)  # land speck of 81 pixels in the sea: a hole that is filled
    rgb[400:404, 100:104] = (250, 250, 250)  # foam of 16 pixels: below the least wave
    rgb[420:430, 100:110] = (250, 250, 250)  # foam of 100 pixels
    return rgb


def rows(spark, rgb):
    flat = rgb.reshape(-1, 3)
    one = spark.createDataFrame([(0, flat[:, 0].tolist(), flat[:, 1].tolist(), flat[:, 2].tolist())], "frame int, r array<int>, g array<int>, b array<int>")
    d = one.select("frame", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pos", "c"))
    return d.select("frame", F.expr("cast(pos div 640 as int) as y"), F.expr("cast(pos % 640 as int) as x"), "c.r", "c.g", "c.b")


def test_full_size_rules(spark):
    d = segment.rule_masks(rows(spark, scene()), ["frame"], 640, 512)
    got = d.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("ocean", "land", "waves")], F.sum((F.col("ocean") & F.col("land")).cast("int")).alias("both")).first()
    sea = 362 * 640
    assert got["waves"] == 100  # the small foam is gone
    # the land speck and both foams are holes of the sea and are filled; the lagoon, filled from the land's side, is land
    assert got["ocean"] == sea and got["land"] == 150 * 640 + 81 + 16 - 81 - 16 + got["both"]
    lagoon = d.filter("y between 20 and 39 and x between 20 and 39")
    assert lagoon.filter("ocean").count() == 0 and lagoon.filter("land").count() == 400
    assert d.filter("y between 300 and 308 and x between 300 and 308 and ocean").count() == 81


def test_no_significant_ocean(spark):
    rgb = scene()
    rgb[150:] = (120, 140, 60)
    got = segment.rule_masks(rows(spark, rgb), ["frame"], 640, 512).filter("ocean or not land").count()
    assert got == 0


def test_full_size_detection(spark):
    """A cold disk by the shore, one far off, one on land: only the first is a plume."""
    y, x = np.mgrid[:512, :640]
    raw = np.full((512, 640), 2950)
    for cy, cx, r in ((60, 200, 9), (400, 400, 12), (20, 500, 9)):
        raw[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = 2900
    surface = np.where(y < 50, 2, 1)
    frame = spark.createDataFrame([(3, y.ravel().tolist(), x.ravel().tolist(), raw.ravel().tolist(), surface.ravel().tolist())], "frame int, y array<int>, x array<int>, raw array<int>, surface array<tinyint>")
    got = detect.detect_frames(frame, DetectConfig(window=0), [1.0, 2.0], ["frame"]).collect()
    area = int((((y - 60) ** 2 + (x - 200) ** 2 <= 81) & (y >= 50)).sum())
    assert sorted((r["threshold"], r["area"], r["min_y"], r["min_shore"]) for r in got) == [(t, area, 51, 0.0) for t in (1.0, 2.0)]
    assert all(abs(r["anomaly"] + 5) < 1e-9 and abs(r["cx"] - 200) < 1e-9 for r in got)
    assert detect.detect_frames(frame.limit(0), DetectConfig(window=0), keys=["frame"]).collect() == []
