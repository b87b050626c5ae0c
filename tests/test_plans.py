"""What the physical plans must and must not contain."""

from dataclasses import replace

import pytest

from surveyspark.catalog import QUERIES
from surveyspark.catalog.baselines import hist
from surveyspark.config import DetectConfig
from surveyspark.plans import detect
from surveyspark.sources.tables import SMALL, pixels


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["distance_join", "detections_vs_known", "dedup_greedy", "point_in_polygon_join", "bbox_overlap_join", "multi_threshold", "frames_x_baselines", "consecutive_overlap"]
)
def test_no_nested_loops(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoop" not in p


def test_detection_moves_pixels_once(spark, sf):
    """Only compact frame arrays are dealt out; what else is exchanged are partial sums of histograms."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = plan(detect.detect(pixels(spark, sf, colocate=detect.KEYS), SMALL)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    added = [below for line, below in zip(lines, lines[1:]) if "Exchange" in line and "REPARTITION_BY_COL" not in line]
    assert len(added) == 1 and all("partial_" in below for below in added), added


def test_only_cold_pixels_become_rows(spark, sf):
    """Frame tables are not exploded at all; the pixels that leave them are the cold ones."""
    frames = detect.frames_of(pixels(spark, sf, colocate=detect.KEYS))
    assert not [line for line in plan(detect.detect_frames(frames, replace(SMALL, window=0))).splitlines() if "Generate" in line and "embedding" not in line]
    n_cold = sum(r.area for r in detect.cold_regions(frames, SMALL).collect())
    assert detect.cold_regions(frames, SMALL, as_pixels=True).count() == n_cold < 0.5 * pixels(spark, sf).count()


def test_histogram_reads_two_columns(spark, sf):
    p = plan(hist(spark, sf))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p


def test_no_row_python(spark, sf):
    for n in ("detect_plumes", "temporal_bias", "segment_rules", "multi_threshold"):
        assert "BatchEvalPython" not in plan(QUERIES[n](spark, sf))


def test_defaults_have_no_frame_cap():
    assert DetectConfig().max_area is None
