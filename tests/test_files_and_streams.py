"""Real files, exports read back, and streams against batch."""

import datetime as dt
import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from surveyspark.catalog.files import exif_blob, export_rows, placemarks
from surveyspark.operators import spatial, state
from surveyspark.sinks import exports
from surveyspark.sources import files
from surveyspark.sources.tables import captures, detections
from surveyspark.streaming import streams


def test_infrared_files_and_pairing(spark, tmp_path):
    rng = np.random.default_rng(0)
    media = tmp_path / "Flight 1 - Bay" / "100MEDIA"
    media.mkdir(parents=True)
    raw = rng.integers(2800, 3000, (512, 640), dtype=np.uint16)
    (media / "IRX_0003.irg").write_bytes(b"HEADER" + raw.astype("<u2").tobytes())
    (media / "MAX_0003.JPG").write_bytes(exif_blob(-27.161, -109.443, 414.24, 37.0, "2023:07:01 16:23:58"))
    (media / "MAX_0004.JPG").write_bytes(b"\xff\xd8" + b'<x Camera:Yaw="-90.5"/>')
    p = files.pairs(spark, str(tmp_path)).collect()
    assert [(r.survey, r.media, r.frame) for r in p] == [("1_bay", "100MEDIA", 3)]
    px = files.read_infrared(spark, str(tmp_path))
    assert px.count() == 640 * 512
    assert px.filter("y = 511 and x = 639").first().raw == int(raw[511, 639])
    f = spark.read.format("binaryFile").option("pathGlobFilter", "MAX_*.JPG").option("recursiveFileLookup", "true").load(str(tmp_path))
    m = {os.path.basename(r.path): r for r in files.metadata(f, ["path"]).collect()}
    a, b = m["MAX_0003.JPG"], m["MAX_0004.JPG"]
    assert abs(a.lat + 27.161) < 1e-8 and abs(a.lon + 109.443) < 1e-8 and a.heading == 37.0 and a.altitude == 414.24
    assert str(a.ts) == "2023-07-01 16:23:58" and b.lat is None and b.heading == 269.5 and b.heading_source == "xmp"


def png(pixels: np.ndarray) -> bytes:
    """Grey, colour or colour-and-alpha image of 8-bit samples."""
    h, w, c = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    rows = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_of_any_channels(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for c in (1, 3, 4):
        p = rng.integers(0, 256, (5, 7, c))
        p[:, :, 3:] = 255
        (tmp_path / f"{c}.png").write_bytes(png(p))
        want |= {(f"{c}.png", y, x): tuple(int(p[y, x, min(k, c - 1)]) for k in range(3)) for y in range(5) for x in range(7)}
    got = {(os.path.basename(r.path), r.y, r.x): (r.r, r.g, r.b) for r in files.read_rgb(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k[0] != "1.png"} == {k: v for k, v in want.items() if k[0] != "1.png"}
    grey = [v for k, v in got.items() if k[0] == "1.png"]
    assert len(grey) == 35 and all(r == g == b for r, g, b in grey)


def test_short_and_late_headed_files(spark, tmp_path):
    (tmp_path / "IRX_0001.irg").write_bytes(b"\1" * 100)
    f = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    r = files.decode_infrared(f, ["path"]).first()
    assert r.raw is None and r.error == "100 of 655360 bytes"
    exif = exif_blob(-27.161, -109.443, 414.24, 37.0, "2023:07:01 16:23:58")
    assert exif[:2] == b"\xff\xd8"
    padding = b"".join(b"\xff\xe2\xff\xff" + b"\0" * 65533 for _ in range(4))  # segments that push the position behind 128 KiB
    spark.createDataFrame([("a", exif[:2] + padding + exif[2:])], "path string, content binary").createOrReplaceTempView("late")
    assert abs(files.metadata(spark.table("late"), ["path"]).first().lat + 27.161) < 1e-8


def test_listing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"MAX_{i:04d}.JPG").write_bytes(b"x" * (i + 1))
    d = streams.run_to_parquet(streams.read_listing(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "work"))
    assert sorted(r.length for r in d.collect()) == [1, 2, 3]


def test_exports_read_back(spark, sf, tmp_path):
    d = export_rows(spark, sf)
    n = d.count()
    exports.write_geojson(d, str(tmp_path / "g"), {"frame": F.col("frame")})
    assert spark.read.schema("type string, geometry struct<type:string>").json(str(tmp_path / "g")).filter("type = 'Feature'").count() == n
    exports.write_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == n
    docs = exports.kml_documents(placemarks(spark, sf).drop("idx"), "frame", per_document=50)
    exports.write_kml(docs, str(tmp_path / "k"))
    back = files.read_kml(spark, str(tmp_path / "k"))
    assert back.count() == n and back.filter(F.size("ring") == 5).count() == n


def test_truncated_location_document(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"metadata": {}, "sites": [{"frame": 1, "lat": -27.1, "lon": -109.4, "area_m2": 55.7}]}')
    (tmp_path / "b.json").write_text('[{"frame": 2, "lat": -27.2, "lon": -109.5, "area_m2": 3.0}]')
    assert sorted(r.frame for r in files.read_locations(spark, str(tmp_path), "sites").collect()) == [1, 2]


def test_state_versions(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, -27.1, -109.4, 5.0), (2, 2, -27.2, -109.4, 6.0)], "ord long, frame long, lat double, lon double, area_m2 double")
    s = spatial.fold_locations(d, 10.0)
    path = str(tmp_path / "s")
    state.write_version(s, path, 0)
    assert state.retract_frame(state.read_version(spark, path, 0), 1).count() == 1
    assert state.reset(spark, path, 0, "x").count() == 0 and spark.read.parquet(f"{path}_backup/snapshot=x").count() == 2


def test_stream_in_daily_files_equals_batch(spark, sf, tmp_path):
    c = captures(spark, sf).select("frame", "flight", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("detected"))
    for i, day in enumerate(sorted(r[0] for r in c.select(F.to_date("ts")).distinct().collect())):
        out = tmp_path / "in" / f"{i:03d}"
        c.filter(F.to_date("ts") == F.lit(day)).coalesce(1).write.parquet(str(out))
        part = next(out.glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"day{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"day{i:03d}.parquet", (1e9 + i, 1e9 + i))
    s = streams.read_frames(spark, str(tmp_path / "in"), c.schema, "day*.parquet", 5)
    got = streams.run_to_parquet(streams.hourly_rate(s, "30 minutes"), str(tmp_path / "run"))
    top = c.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    w = F.window("ts", "30 minutes")
    want = c.groupBy(w).agg(F.count(F.lit(1)).alias("captures"), F.sum(F.col("detected").cast("int")).alias("detections")).filter(F.col("window.end") <= F.lit(top))
    key = lambda d, *k: sorted(tuple(r) for r in d.select(*k).collect())
    assert key(got, "start", "captures", "detections") == key(want, "window.start", "captures", "detections")


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, detected boolean"
    for i, stamps in enumerate((["2024-01-01 10:05:00", "2024-01-01 12:00:00"], ["2024-01-01 12:01:00"], ["2024-01-01 10:10:00", "2024-01-01 13:00:00"])):
        spark.createDataFrame([(dt.datetime.fromisoformat(s), True) for s in stamps], schema).coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        f = next((tmp_path / f"d{i}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        f.rename(tmp_path / "in" / f"f{i}.parquet")
        os.utime(tmp_path / "in" / f"f{i}.parquet", (1e9 + i, 1e9 + i))
    s = streams.read_frames(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "f*.parquet", 1)
    got = streams.run_to_parquet(streams.hourly_rate(s), str(tmp_path / "run")).collect()
    assert {str(r.start): r.captures for r in got} == {"2024-01-01 10:00:00": 1, "2024-01-01 12:00:00": 2}


def land(d, folder, names):
    """One file each, in the order of the names; returns a stream of one file a trigger."""
    (folder / "in").mkdir(parents=True, exist_ok=True)
    for i, (name, condition) in enumerate(names):
        d.filter(condition).coalesce(1).write.parquet(str(folder / name))
        f = next((folder / name).glob("part-*.parquet"))
        f.rename(folder / "in" / f"{name}.parquet")
        os.utime(folder / "in" / f"{name}.parquet", (1e9 + i, 1e9 + i))
    return streams.read_frames(d.sparkSession, str(folder / "in"), d.schema, "*.parquet", 1)


def test_stream_dedup_in_any_order(spark, sf, tmp_path):
    d = detections(spark, sf).select(F.col("frame").alias("ord"), "frame", F.timestamp_seconds(F.col("frame") * 60).alias("ts"), "lat", "lon", "area_m2")
    s = land(d, tmp_path, [("c", "frame % 3 = 2"), ("a", "frame % 3 = 0"), ("b", "frame % 3 = 1")])
    v = streams.dedup_locations(s, str(tmp_path / "set"), 10.0, "3650 days")
    key = lambda x: sorted(tuple(r) for r in x.select(*state.COLUMNS).collect())
    assert key(state.read_version(spark, str(tmp_path / "set"), v)) == key(spatial.fold_locations(d.drop("ts"), 10.0))


def test_delay_spans_long_surveys(spark, tmp_path):
    """Seven million frames a minute apart take 13 years; the first ones come last and still count."""
    from surveyspark.catalog.streams import any_order, timed

    d = timed(spark.createDataFrame([(f, f, 0.01 * k, 0.0, 1.0) for k, f in enumerate((0, 1, 7_000_000))], "ord long, frame long, lat double, lon double, area_m2 double"))
    s = land(d, tmp_path, [("b", "frame = 7000000"), ("a", "frame < 2")])
    v = streams.dedup_locations(s, str(tmp_path / "set"), 10.0, any_order(spark, str(tmp_path / "in")))
    assert sorted(r.location for r in state.read_version(spark, str(tmp_path / "set"), v).collect()) == [0, 1, 7_000_000]


def test_frames_are_stepped_in_order_and_gaps_expire(spark, tmp_path):
    """Frames arrive backwards; 4 is lost, 9 arrives after the watermark has passed it. Medians differ by frame."""
    rows = [(7, f, f * 0.5) for f in (0, 1, 2, 3, 5, 6, 7, 8, 10)] + [(8, 0, 9.0), (8, 1, 9.5)]
    d = spark.createDataFrame(rows + [(7, 200, 1.0), (7, 201, 1.0), (7, 9, 50.0)], "media int, frame long, median double").withColumn("ts", F.timestamp_seconds(F.col("frame") * 60 + 1_700_000_000))
    files = [("a", "frame between 5 and 10 and frame <> 9"), ("b", "frame between 1 and 3"), ("c", "frame = 0"), ("d", "frame = 200"), ("e", "frame = 201"), ("f", "frame = 9")]
    with streams.keyed_state(spark):
        s = land(d, tmp_path, files)
        got = streams.run_to_parquet(streams.glint_history(s, late="1 hour"), str(tmp_path / "work"))
    seen = {(r.media, r.frame): r for r in got.collect()}
    # No closing mark: what follows its predecessor or has been overtaken by the watermark is out, 200 and 201 still wait.
    assert sorted(seen) == sorted((m, f) for m, f, _ in rows)
    assert seen[7, 0].temp_jump is None and seen[7, 1].temp_jump == 0.5
    assert seen[7, 5].temp_jump == 1.0 and seen[7, 10].temp_jump == 1.0  # 4 was lost, 9 came too late
    assert seen[7, 10].deviation == abs(5.0 - (2.5 + 3.0 + 3.5 + 4.0) / 4)
    assert seen[8, 1].temp_jump == 0.5


def test_pairs_as_they_land(spark, tmp_path):
    mk = lambda rows, side: spark.createDataFrame([(1, f, f"{side}{f}") for f in rows], "media int, frame long, path string").withColumn("ts", F.timestamp_seconds(F.col("frame") * 600 + 1_700_000_000))
    a = land(mk([0, 1, 2, 4, 100], "rgb"), tmp_path / "a", [("x", "frame = 2"), ("y", "frame < 2"), ("z", "frame > 2")])
    b = land(mk([1, 2, 3, 100], "ir"), tmp_path / "b", [("x", "frame = 3"), ("y", "frame < 2"), ("z", "frame in (2, 100)")])
    got = streams.run_to_parquet(streams.paired_frames(a, b, late="2 hours"), str(tmp_path / "work"))
    rows = sorted(tuple(r)[1:] for r in got.collect())
    assert rows == [(0, "rgb0", None), (1, "rgb1", "ir1"), (2, "rgb2", "ir2"), (3, None, "ir3"), (4, "rgb4", None), (100, "rgb100", "ir100")]


def test_pairs_are_closed(spark, tmp_path):
    """Closing marks carry no frame; they must still move the watermark, and frames without a partner come out."""
    mk = lambda rows, side: spark.createDataFrame([(1, f, f"{side}{f}") for f in rows], "media int, frame long, path string").withColumn("ts", F.timestamp_seconds(F.coalesce("frame", F.lit(0)) * 60 + 1_700_000_000))
    a = land(mk([0, 1, None], "rgb"), tmp_path / "a", [("x", "true")])
    b = land(mk([1, 2], "ir"), tmp_path / "b", [("x", "true")])
    got = streams.drain(lambda x, y: streams.paired_frames(x, y, late="3650 days"), [a, b], str(tmp_path / "work"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, "rgb0", None), (1, "rgb1", "ir1"), (2, None, "ir2")]


def test_layouts_are_told_apart(spark):
    import numpy as np

    from surveyspark.sources import files

    rng = np.random.default_rng(3)
    raw = rng.integers(2850, 3100, 12)
    halves = raw.astype("<u2").tobytes()
    made = {
        1: b"HEAD" * 2 + halves, 2: halves + b"\xff" * 8, 3: (raw / 10 - 273.15).astype("<f4").tobytes(), 4: halves, 5: b"short", 6: None,
        7: b"\0" * 24 + halves,  # as long as floats would be
        8: np.array([np.nan, np.inf, *(raw[2:] / 10 - 273.15)], "<f4").tobytes(),
    }
    d = spark.createDataFrame(list(made.items()), "frame int, content binary")
    got = {r.frame: r for r in files.probe_infrared(d, ["frame"], 4, 3).collect()}
    assert {k: r.layout for k, r in got.items()} == {1: "headed16", 2: "trailed16", 3: "float32", 4: "headed16", 5: None, 6: None, 7: "headed16", 8: "float32"}
    assert all(got[k].raw == raw.tolist() and got[k].plausible == 1.0 and got[k].error is None for k in (1, 2, 3, 4, 7))
    assert got[8].raw == [-1, -1, *raw[2:].tolist()] and got[5].raw is None and "5 of 24" in got[5].error and got[6].error == "0 of 24 bytes"
