"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from surveyspark.catalog import QUERIES  # noqa: E402
from surveyspark.config import DetectConfig  # noqa: E402
from surveyspark.operators import spatial  # noqa: E402
from surveyspark.plans import detect as D  # noqa: E402
from surveyspark.session import build_session  # noqa: E402
from surveyspark.sources.tables import captures, full_size_pixels  # noqa: E402

HEADLINE = [
    "cold_frames",
    "ocean_stats",
    "moving_baseline",
    "running_deviation",
    "segment_rules",
    "shore_distance",
    "label_regions",
    "detect_plumes",
    "multi_threshold",
    "glint_confidence",
    "georeference_plumes",
    "dedup_greedy",
    "merge_bboxes",
    "point_in_polygon_join",
    "temporal_bias",
    "campaign_rollup",
    "to_kml_placemarks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cold_frames"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    frames, cfg = 64, DetectConfig(window=0, max_shore=200.0)
    arrays = D.frames_of(full_size_pixels(spark, sf, frames), ["frame"]).cache()  # the form in which frames are stored
    arrays.count()
    D.detect_frames(arrays, cfg, keys=["frame"]).write.format("noop").mode("overwrite").save()
    t = time.perf_counter()
    D.detect_frames(arrays, cfg, keys=["frame"]).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t
    arrays.unpersist()
    points = captures(spark, sf).select(F.col("frame").alias("ord"), "frame", "lat", "lon", F.col("value").alias("area_m2"))
    t = time.perf_counter()
    spatial.fold_locations(points, 10.0).write.format("noop").mode("overwrite").save()
    extra = {
        "full_size_frames": frames, "detect_seconds": round(took, 3), "frames_per_second": round(frames / took, 3),
        "frames_per_second_per_core": round(frames / took / int(cpus), 3), "fold_captures_seconds": round(time.perf_counter() - t, 3),
    }
    print(json.dumps({"metric": "survey_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "full_size": extra}))
    spark.stop()


if __name__ == "__main__":
    main()
