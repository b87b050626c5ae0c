"""Sources fed with bytes and documents derived from the tables, and the exports."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from ..functions import colour, geo, rings, text
from ..operators import spatial, state
from ..operators.ordered import with_index
from ..session import cut_lineage, shared_folder
from ..sinks import exports as X
from ..sources import files as S
from ..sources.tables import H, W, boxes, captures, detections, pixels, table
from .base import query
from .baselines import rounded
from .reports import _SUM, _SKIP, _summary_columns, survey_rows
from .spatials import R, points, shown

C = F.col


# ---- sources -----------------------------------------------------------------------------------


def paths(spark, sf):
    """Capture log as file names, four-digit frame numbers in nnnMEDIA folders of a flight."""
    f = C("frame")
    return captures(spark, sf).select(
        F.format_string("/surveys/Flight %d - Coast/%dMEDIA/MAX_%04d.JPG", C("flight"), F.lit(100) + f % 8, f).alias("path")
    )


@query(
    "scan_frame_inventory",
    "select frame, cast(100 + frame % 8 as varchar) || 'MEDIA' as media, flight || '_coast' as survey from captures",
)
def scan_frame_inventory(spark, sf):
    return S.parse_paths(paths(spark, sf)).select(C("frame").cast("bigint").alias("frame"), "media", "survey")


@query("scan_campaign", "select flight || '_coast' as survey, count(distinct frame % 8) as n_media, count(*) as n_frames from captures group by flight")
def scan_campaign(spark, sf):
    d = S.parse_paths(paths(spark, sf)).filter(C("media").rlike(r"^\d{3}MEDIA$"))
    return d.groupBy("survey").agg(F.countDistinct("media").alias("n_media"), F.count(F.lit(1)).alias("n_frames"))


@query("scan_path_parts", "select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) as folder, try_cast(regexp_extract(url, '/([0-9]+)([?#]|$)', 1) as bigint) as number from pages")
def scan_path_parts(spark, sf):
    u = C("url")
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(u, r"^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract(u, r"^https?://[^/]+/([^/]+)/", 1).alias("folder"),
        F.regexp_extract(u, r"/([0-9]+)([?#]|$)", 1).try_cast("bigint").alias("number"),
    )


@query("scan_infrared_raw", "select frame, y, x, raw from px")
def scan_infrared_raw(spark, sf):
    """Rasters written out as headed 16-bit files and read back."""
    px = pixels(spark, sf, colocate=["frame"])
    word = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8)), 2, "0"))
    cells = F.array_sort(F.collect_set(F.struct((C("y") * 8 + C("x")).alias("p"), C("raw").cast("bigint").alias("raw"))))
    f = px.groupBy("frame").agg(cells.alias("c"))
    body = F.array_join(F.transform("c", lambda e: word(e["raw"])), "")
    f = f.select("frame", F.unhex(F.concat(F.lit("00FF10"), body)).alias("content"))
    return S.to_pixels(S.decode_infrared(f, ["frame"], W, H), ["frame"], W)


@query("scan_infrared_layouts", "select frame, y, x, raw, case frame % 3 when 0 then 'headed16' when 1 then 'trailed16' else 'float32' end as layout from px")
def scan_infrared_layouts(spark, sf):
    """Files of three layouts side by side; each one's is found from its readings."""
    px = pixels(spark, sf, colocate=["frame"])
    f = px.groupBy("frame").agg(F.array_sort(F.collect_set(F.struct((C("y") * W + C("x")).alias("p"), "raw"))).alias("c"))
    kinds = F.array(F.lit("headed16"), F.lit("trailed16"), F.lit("float32"))
    f = f.select("frame", F.transform("c", lambda e: e["raw"]).alias("raw"), F.get(kinds, (C("frame") % 3).cast("int")).alias("layout"))
    d = S.probe_infrared(S.encode_infrared(f, ["frame"], bytes(64), bytes(range(32))), ["frame"], W, H)
    return S.to_pixels(d.select("frame", "raw", "layout"), ["frame", "layout"], W).select("frame", "y", "x", "raw", "layout")


@query("scan_rgb", "select frame, y, x, r, g, b from px")
def scan_rgb(spark, sf):
    """Interleaved blue-green-red bytes, as the image source delivers them, to channel columns."""
    px = pixels(spark, sf, colocate=["frame"])
    two = lambda c: F.lpad(F.hex(C(c).cast("bigint")), 2, "0")
    cell = F.struct((C("y") * 8 + C("x")).alias("p"), F.concat(two("b"), two("g"), two("r")).alias("h"))
    d = px.groupBy("frame").agg(F.array_sort(F.collect_set(cell)).alias("c"))
    d = d.select("frame", F.unhex(F.array_join(F.transform("c", lambda e: e["h"]), "")).alias("data"))
    e = d.select("frame", "data", F.explode(F.sequence(F.lit(0), F.lit(W * H - 1))).alias("p"))
    byte = lambda k: F.conv(F.hex(F.substring("data", C("p") * 3 + 1 + k, F.lit(1))), 16, 10).cast("int")
    return e.select(
        "frame", F.expr("cast(p div 8 as int)").alias("y"), (C("p") % 8).cast("int").alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b")
    )


def exif_blob(lat, lon, altitude, heading, stamp) -> bytes:
    """A minimal little-endian tag segment, for feeding the reader."""

    def dms(v):
        v = abs(v)
        d, m = int(v), int(v * 60 % 60)
        return struct.pack("<6I", d, 1, m, 1, round((v * 3600 - d * 3600 - m * 60) * 1e6), 10**6)

    gps_at, extra = 8 + 2 + 2 * 12 + 4, 8 + 2 + 2 * 12 + 4 + 2 + 6 * 12 + 4
    data = dms(lat) + dms(lon) + struct.pack("<4I", round(altitude * 1000), 1000, round(heading * 100), 100) + stamp.encode() + b"\0"
    ref = lambda c: c.encode() + b"\0\0\0"
    ent = lambda tag, kind, n, v: struct.pack("<HHI", tag, kind, n) + (v if isinstance(v, bytes) else struct.pack("<I", v))
    top = struct.pack("<H", 2) + ent(0x0132, 2, 20, extra + 64) + ent(0x8825, 4, 1, gps_at) + b"\0" * 4
    gps = struct.pack("<H", 6) + ent(1, 2, 2, ref("S" if lat < 0 else "N")) + ent(2, 5, 3, extra) + ent(3, 2, 2, ref("W" if lon < 0 else "E"))
    gps += ent(4, 5, 3, extra + 24) + ent(6, 5, 1, extra + 48) + ent(17, 5, 1, extra + 56) + b"\0" * 4
    return b"\xff\xd8Exif\0\0" + b"II*\0\x08\0\0\0" + top + gps + data


@query(
    "extract_gps",
    "select frame, round(lat,6) as lat, round(lon,6) as lon, altitude::double as altitude, heading::double as heading, strftime(ts,'%Y-%m-%d %H:%M:%S') as taken from captures",
)
def extract_gps(spark, sf):
    def write(batches):
        for b in batches:
            blobs = [exif_blob(*v) for v in zip(b["lat"], b["lon"], b["altitude"], b["heading"], b["stamp"])]
            yield pd.DataFrame({"frame": b["frame"], "content": blobs})

    c = captures(spark, sf).select("frame", "lat", "lon", "altitude", "heading", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("stamp"))
    m = S.metadata(c.mapInPandas(write, "frame bigint, content binary"), ["frame"])
    return m.select(
        "frame", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "altitude", "heading", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("taken")
    )


@query("scan_xmp_heading", "select frame, case when frame % 3 = 0 then null when heading-180 < 0 then heading-180+360e0 else (heading-180)::double end as heading from captures")
def scan_xmp_heading(spark, sf):
    yaw = (C("heading") - 180).cast("string")
    xmp = F.when(C("frame") % 3 == 0, F.lit("<x/>")).otherwise(F.concat(F.lit('<x Camera:Yaw="'), yaw, F.lit('"/>')))
    return captures(spark, sf).select("frame", text.xmp_heading(xmp).alias("heading"))


@query("scan_detection_json", "select event_id, json_extract(props,'$.k')::bigint as k, 'MAX_' || event_id as rgb_frame, strftime(ts,'%Y-%m-%dT%H:%M:%S') as stamp from events")
def scan_detection_json(spark, sf):
    e = table(spark, sf, "events")
    rec = F.struct(F.concat(F.lit("MAX_"), "event_id").alias("rgb_frame"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"))
    doc = F.to_json(F.struct(F.array(rec).alias("detections")))
    d = e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.inline(S.detection_records(doc)))
    return d.select("event_id", "k", "rgb_frame", C("datetime").alias("stamp"))


@query("scan_location_json", "select frame, round(lat,8) as lat, round(lon,8) as lon, area_m2 from dets")
def scan_location_json(spark, sf):
    """Both document layouts, one location each."""
    rec = F.array(F.struct("frame", "lat", "lon", "area_m2"))
    doc = F.when(C("frame") % 2 == 0, F.to_json(F.struct(rec.alias("locations")))).otherwise(F.to_json(rec))
    d = detections(spark, sf).select(doc.alias("doc")).select(F.inline(S.location_records(C("doc"), "locations")))
    return rounded(d.select("frame", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "area_m2"), 8)


@query("scan_kml_polygons", "select frame, round(lon-half,6) as first_lon, round(lat-half,6) as first_lat, 5 as n_points from dets")
def scan_kml_polygons(spark, sf):
    p = S.parse_placemark(C("placemark"))
    d = placemarks(spark, sf).select("frame", p.alias("p")).withColumn("ring", rings.parse_kml(C("p.Polygon.outerBoundaryIs.LinearRing.coordinates")))
    return d.select("frame", C("ring")[0]["lon"].alias("first_lon"), C("ring")[0]["lat"].alias("first_lat"), F.size("ring").alias("n_points"))


@query("scan_training_samples", "select vec_id, label, len(embedding) as dims, round(list_sum(embedding::double[]),6) as total from embeddings")
def scan_training_samples(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(C("embedding").cast("array<double>")).alias("features"))
    a = vector_to_array("features")
    return e.select("vec_id", "label", F.size(a).alias("dims"), F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def _state_folder(spark) -> str:
    """A fresh folder in the shared checkpoint area."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}"


@query("scan_survey_state", "select location, round(lat,8) as lat, round(lon,8) as lon, first_frame, last_frame, detection_count, area_m2, geometry_frame from fold")
def scan_survey_state(spark, sf):
    path = _state_folder(spark)
    state.write_version(spatial.fold_locations(points(spark, sf), R), path, 1)
    return shown(state.read_version(spark, path, 1))


@query("state_reset_backup", "select 'current' as part, 0::bigint as n union all select 'snapshot' as part, count(*) as n from fold")
def state_reset_backup(spark, sf):
    path = _state_folder(spark)
    state.write_version(spatial.fold_locations(points(spark, sf), R), path, 1)
    now = state.reset(spark, path, 1, "20240131")
    kept = spark.read.parquet(f"{path}_backup/snapshot=20240131")
    n = F.count(F.lit(1)).alias("n")
    return now.agg(n).select(F.lit("current").alias("part"), "n").union(kept.agg(n).select(F.lit("snapshot").alias("part"), "n"))


@query("save_frame_products", "select media, count(*) as n, sum(raw)::bigint as total from px where ocean group by media")
def save_frame_products(spark, sf):
    path = _state_folder(spark)
    X.write_frame_products(pixels(spark, sf).filter("ocean").select("media", "frame", "y", "x", "raw"), path)
    return spark.read.parquet(path).groupBy("media").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total"))


# ---- exports -----------------------------------------------------------------------------------


def export_rows(spark, sf):
    d = detections(spark, sf)
    ring = F.when(C("frame") % 4 != 0, rings.square(C("lon"), C("lat"), C("half")))
    return d.select(
        "frame", "flight", "lat", "lon", "area_m2", "anomaly", "altitude", ring.alias("ring"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("datetime"),
        F.round(C("area_m2") * 100).cast("bigint").alias("area_pixels"), (C("frame") % 7 / 2.0).alias("shore_distance"), (C("frame") % 10 / 10.0).alias("eccentricity"),
    )


@query(
    "to_geojson",
    """select frame, case when frame % 4 <> 0 then 'Polygon' else 'Point' end as kind, round(area_m2,2) as area, round(altitude,1)::double as altitude, 'Feature' as type,
      round(case when frame % 4 <> 0 then lon-half else lon end,6) as first_lon from dets""",
)
def to_geojson(spark, sf):
    f = X.geojson_feature(
        {"frame": C("frame"), "area_m2": F.round("area_m2", 2), "temperature_anomaly": F.round("anomaly", 2), "altitude": F.round(C("altitude").cast("double"), 1)}
    )
    d = export_rows(spark, sf).select(f.alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return d.select(
        at("$.properties.frame").cast("bigint").alias("frame"),
        at("$.geometry.type").alias("kind"),
        at("$.properties.area_m2").cast("double").alias("area"),
        at("$.properties.altitude").cast("double").alias("altitude"),
        at("$.type").alias("type"),
        F.round(F.coalesce(at("$.geometry.coordinates[0][0][0]"), at("$.geometry.coordinates[0]")).cast("double"), 6).alias("first_lon"),
    )


@query(
    "to_csv_areas",
    """select frame, strftime(ts,'%Y:%m:%d %H:%M:%S') as datetime, round(lat,8) as centroid_lat, round(lon,8) as centroid_lon, printf('%.2f', area_m2) as area_m2, round(area_m2*100)::bigint as area_pixels,
      printf('%.2f', anomaly+1e-9) as temperature_anomaly, printf('%.1f', frame%7/2e0) as shore_distance, printf('%.1f', altitude::double) as altitude, printf('%.3f', frame%10/10e0) as eccentricity,
      case when frame % 4 <> 0 then 'yes' else 'no' end as has_polygon from dets""",
)
def to_csv_areas(spark, sf):
    """Anomalies are nudged off decimal ties, which the two printf's break differently."""
    d = X.csv_rows(export_rows(spark, sf).withColumn("anomaly", C("anomaly") + 1e-9))
    return d.withColumn("centroid_lat", F.round("centroid_lat", 8)).withColumn("centroid_lon", F.round("centroid_lon", 8))


def placemarks(spark, sf):
    d = detections(spark, sf).withColumn("ring", rings.square(C("lon"), C("lat"), C("half")))
    d = with_index(d, [], "frame").withColumn("number", C("idx") + 1)
    return d.withColumn("anomaly", C("anomaly") + 1e-7).withColumn("area_m2", C("area_m2") + 1e-7).select("frame", "flight", "area_m2", "idx", X.location_placemark().alias("placemark"))


def _p(a, b):
    return f"printf('%.6f,%.6f,0', lon{a}half, lat{b}half)"


_RING = f"{_p('-','-')} || ' ' || {_p('+','-')} || ' ' || {_p('+','+')} || ' ' || {_p('-','+')} || ' ' || {_p('-','-')}"
_POLY = f"'<Polygon><extrude>0</extrude><altitudeMode>clampToGround</altitudeMode><outerBoundaryIs><LinearRing><coordinates>' || {_RING} || '</coordinates></LinearRing></outerBoundaryIs></Polygon>'"


@query(
    "to_kml_placemarks",
    f"""select frame, '<Placemark><name>Location ' || row_number() over (order by frame) || ' (Frame ' || frame || ')</name><description><![CDATA[Frame: ' || frame || chr(10) ||
      'Area: ' || printf('%.1f', area_m2+1e-7) || ' m²' || chr(10) || 'Temperature anomaly: ' || printf('%.1f', anomaly+1e-7) || '°C]]></description><styleUrl>#plume</styleUrl>' || {_POLY} || '</Placemark>' as placemark from dets""",
)
def to_kml_placemarks(spark, sf):
    return placemarks(spark, sf).select("frame", "placemark")


@query("kml_documents", "select flight, 0::bigint as part, count(*) as n from dets group by flight")
def kml_documents(spark, sf):
    d = X.kml_documents(placemarks(spark, sf).drop("idx"), "frame", ["flight"], X.style(F.lit("plume"), F.lit("ff0000ff")))
    n = (F.length("value") - F.length(F.replace("value", F.lit("<Placemark>"), F.lit("")))) / 11
    return d.select("flight", "part", n.cast("bigint").alias("n"))


@query(
    "to_kml_thresholds",
    f"""select frame, threshold, name as colour, '<Placemark><name>' || printf('%.1f', threshold) || ' C</name><description><![CDATA[Area: ' || printf('%.1f', area_m2+1e-7) || ' m²]]></description><styleUrl>#' || name || '</styleUrl>' || {_POLY} || '</Placemark>' as placemark
      from dets, (values (0.5e0,'yellow'),(1.0e0,'green'),(1.5e0,'orange'),(2.0e0,'red')) t(threshold, name) where -anomaly > threshold""",
)
def to_kml_thresholds(spark, sf):
    """A detection appears in the folder of every threshold it passes."""
    passed = F.filter(text.threshold_series(0.5, 0.5, 4), lambda t: -C("anomaly") > t)
    d = detections(spark, sf).withColumn("ring", rings.square(C("lon"), C("lat"), C("half"))).withColumn("threshold", F.explode(passed))
    d = d.withColumn("colour", colour.threshold_colour(C("threshold"))["name"]).withColumn("area_m2", C("area_m2") + 1e-7)
    p = X.placemark(F.concat(X.fixed("threshold", 1), F.lit(" C")), [F.concat(F.lit("Area: "), X.fixed("area_m2", 1), F.lit(" m²"))], C("colour"), C("ring"))
    return d.select("frame", "threshold", "colour", p.alias("placemark"))


@query(
    "to_kml_footprints",
    f"""select frame, 'dir_' || ((dense_rank() over (order by flight)) - 1) as style, {colour.DIRECTORY_COLOURS}[((dense_rank() over (order by flight)) - 1) % 6 + 1] as colour, 5 as n_points from captures""",
)
def to_kml_footprints(spark, sf):
    c = captures(spark, sf)
    pos = with_index(c.select("flight").distinct(), [], "flight", out="position")
    d = c.select("frame", "flight", "lat", "lon", "altitude", geo.footprint_corners(C("lat"), C("lon"), C("altitude"), C("heading")).alias("ring")).join(pos, "flight")
    st = F.concat(F.lit("dir_"), C("position").cast("string"))
    p = X.placemark(
        F.concat(F.lit("Frame "), C("frame").cast("string")), [F.concat(F.lit("Altitude: "), X.fixed("altitude", 1), F.lit(" m"))], st, C("ring")
    )
    d = d.withColumn("placemark", p)
    back = rings.parse_kml(F.regexp_extract("placemark", "<coordinates>([^<]*)", 1))
    return d.select("frame", F.regexp_extract("placemark", "#([^<]*)<", 1).alias("style"), X.directory_colour(C("position")).alias("colour"), F.size(back).alias("n_points"))


@query(
    "to_kml_merged",
    """select round(min_lon,9) as min_lon, n, round((max_lon-min_lon)*(max_lat-min_lat)*111000e0*111000e0,3) as area_m2,
      round((select sum((max_lon-min_lon)*(max_lat-min_lat)) from mboxes)*111000e0*111000e0,2) as total_m2, (select count(*) from mboxes) as n_shapes from mboxes""",
)
def to_kml_merged(spark, sf):
    m = cut_lineage(spatial.merge_boxes(boxes(spark, sf)))
    corner = lambda a, b: geo.point(C(f"{a}_lon"), C(f"{b}_lat"))
    ring = F.array(corner("min", "min"), corner("max", "min"), corner("max", "max"), corner("min", "max"))
    d = m.withColumn("ring", ring).withColumn("area", rings.area_deg_m2(C("ring"))).withColumn("lon", C("min_lon")).withColumn("lat", C("min_lat"))
    head = d.agg(F.struct(F.sum("area").alias("t"), F.count(F.lit(1)).alias("k"))).scalar()
    d = d.withColumn("h", head).withColumn(
        "placemark", X.placemark(F.lit("Merged"), [F.concat(F.lit("Area: "), X.fixed("area", 1), F.lit(" m²"))], F.lit("merged"), rings.close(C("ring")))
    )
    return d.filter(C("placemark").contains("</LinearRing>")).select(
        F.round("min_lon", 9).alias("min_lon"), "n", F.round("area", 3).alias("area_m2"), F.round("h.t", 2).alias("total_m2"), C("h.k").alias("n_shapes")
    )


@query("to_summary_json", f"select frames_total, frames_processed, detections, total_area_m2 from (select {_SUM} from {_SKIP})")
def to_summary_json(spark, sf):
    j = survey_rows(spark, sf).agg(*_summary_columns()).select(F.to_json(F.struct(F.struct("*").alias("statistics"))).alias("value"))
    d = j.select(F.from_json("value", "statistics struct<frames_total:bigint,frames_processed:bigint,detections:bigint,total_area_m2:double>").alias("d"))
    return d.select("d.statistics.*")
