"""Hand-made scenes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.catalog.spatials import dissolve
from surveyspark.config import Camera, DetectConfig
from surveyspark.functions import rings, text
from surveyspark.operators import baseline, glint, regions, spatial
from surveyspark.operators import temporal as T
from surveyspark.plans import detect


def squares(spark):
    c = [(-109.4401, -109.4400, -27.1501, -27.1500), (-109.4400, -109.4399, -27.1501, -27.1500),
         (-109.4395, -109.4394, -27.1502, -27.1501), (-109.4395, -109.4394, -27.1503, -27.1502)]
    return spark.createDataFrame(c, "min_lon double, max_lon double, min_lat double, max_lat double")


def test_four_squares_merge_into_two(spark):
    m = spatial.merge_boxes(squares(spark)).collect()
    areas = sorted((r.max_lon - r.min_lon) * (r.max_lat - r.min_lat) * 111000**2 for r in m)
    assert [r.n for r in m] == [2, 2]
    assert areas[0] == pytest.approx(246.4, abs=0.1) and sum(areas) == pytest.approx(492.8, abs=0.1)


def test_dissolved_squares(spark):
    c = [F.struct(F.col(a).alias("lon"), F.col(b).alias("lat")) for a, b in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))]
    d = dissolve(squares(spark).select(F.array(*c).alias("ring")), [], 1e-5, 3.3e-7, tile=8).collect()
    assert sorted(r.n_cells for r in d) == [200, 200]


def mask_rows(spark, rects):
    cells = {(y, x) for y0, y1, x0, x1 in rects for y in range(y0, y1) for x in range(x0, x1)}
    return spark.createDataFrame([(0, y, x) for y, x in cells], "frame int, y int, x int")


@pytest.mark.parametrize(
    "rects,regions_left",
    [
        ([(50, 80, 50, 80), (200, 230, 300, 330), (400, 430, 500, 530)], 0),
        ([(100, 400, 100, 500), (10, 40, 10, 40), (450, 480, 600, 630)], 1),
        ([(0, 128, 0, 100)], 0),
        ([(0, 128, 0, 154)], 1),
    ],
)
def test_only_a_significant_ocean_is_kept(spark, rects, regions_left):
    kept = regions.largest_component(mask_rows(spark, rects), ["frame"], 640, 512)
    lab = regions.label_regions(kept, ["frame"], 640)
    assert lab.select("region").distinct().count() == regions_left


def test_area_names(spark):
    want = {
        "/v/Flight 3 - Bay - West": "3_bay_west",
        "/v/Flight 1 - Test/100MEDIA": "1_test",
        "/v/flight_2-North Bay!/": "2_north_bay",
        "/v/---": "___",
        "/v/!!!": "unnamed_area",
    }
    d = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.a for r in d.select("p", text.area_name(F.col("p")).alias("a")).collect()} == want


def test_constant_frame_modal_baseline(spark):
    h = spark.createDataFrame([(1, 2950, 10)], "frame int, raw int, n long")
    assert baseline.modal_baseline(h, ["frame"]).first().baseline == pytest.approx(2950 / 10 - 273.15 + 0.01)


def scene(spark, bright):
    """Sea at 20 degrees, a 300 x 300 patch at 15, land above; built on executors."""
    d = spark.range(1).select(F.lit(1).cast("long").alias("frame"), F.lit(100).alias("media"), F.explode(F.sequence(F.lit(0), F.lit(511))).alias("y"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(639))).alias("x"))
    patch = F.col("y").between(100, 399) & F.col("x").between(200, 499)
    noise = (F.col("y") * 7 + F.col("x") * 3) % 11 - 5
    return d.select(
        "*", F.when(patch, 2881 + noise).otherwise(2931 + noise).alias("raw"), (F.col("y") >= 50).alias("ocean"), (F.col("y") < 50).alias("land"), F.lit(False).alias("waves"),
        *[F.when(patch & F.lit(bright), 230).otherwise(100).alias(c) for c in "rgb"],
    ).repartition("frame")


@pytest.mark.parametrize("bright,tenths", [(False, 3), (True, 7)])
def test_glint_scene(spark, bright, tenths):
    px, k = scene(spark, bright), detect.KEYS
    h = baseline.temp_hist(px, k)
    cfg = DetectConfig(threshold=1.0, min_area=50, max_shore=200.0, window=0)
    p = detect.accept(detect.regions_of(px, cfg), cfg)
    cont = baseline.continuity(baseline.percentile_baseline(h, k, 0.5, out="median"), ["media"])
    v = glint.confidence(glint.rgb_evidence(glint.summary(px, k), k), glint.infrared_evidence(h, p, k), cont, None, k).first()
    assert (v.tenths, v.has_glint) == (tenths, bright)


def test_full_size_plume(spark):
    px = scene(spark, False)
    cfg = DetectConfig(threshold=1.0, min_area=50, max_shore=200.0, window=0, camera=Camera())
    r = detect.accept(detect.regions_of(px, cfg), cfg).collect()
    assert len(r) == 1 and r[0].area == 90000 and (r[0].min_y, r[0].min_x, r[0].max_y, r[0].max_x) == (100, 200, 400, 500)
    assert r[0].cy == pytest.approx(249.5) and r[0].anomaly == pytest.approx(-4.8, abs=0.1)
    assert r[0].min_shore == pytest.approx(100 - 51)  # shoreline is the two ocean rows next to land


def test_outline_of_a_square_and_a_diagonal_pair(spark):
    d = spark.createDataFrame([(0, y, x) for y in (2, 3) for x in (5, 6)] + [(1, 0, 0), (1, 1, 1)], "frame int, y int, x int")
    o = {r.frame: r.ring for r in regions.outline(regions.label_regions(d, ["frame"], 10), ["frame"], 10).collect()}
    assert len(o[0]) == 9 and o[0][0] == o[0][-1]
    assert len(o[1]) == 9  # one ring through both pixels


def test_p_values():
    assert T.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert T.chi_square_p(31.26413362, 11) == pytest.approx(0.001, abs=1e-8)
    assert T.ks_p(0.5, 10, 10) == pytest.approx(0.1641, abs=1e-3)


def test_ring_normalisation(spark):
    d = spark.createDataFrame([("[[0,0],[0,1],[1,1],[1,0]]",), ('[{"lon":0,"lat":0},{"lon":1,"lat":0},{"lon":1,"lat":1}]',), ("[[0,0],[1,1]]",)], "j string")
    r = [x.r for x in d.select(rings.normalise(F.col("j")).alias("r")).collect()]
    assert [len(x) if x else None for x in r] == [5, 4, None]
    assert np.isclose(r[0][1].lon, 1.0)  # turned counter-clockwise
