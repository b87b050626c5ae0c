"""Reading survey directories and the documents that travel with them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, rings, text

C = F.col


def inventory(spark: SparkSession, root: str, pattern: str = "MAX_*.JPG") -> DataFrame:
    """(path, survey, media, frame) of matching files below ``root``; contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return parse_paths(d.select("path", "modificationTime", "length"))


def parse_paths(d: DataFrame) -> DataFrame:
    return d.withColumn("survey", text.area_name(F.regexp_replace("path", r"/[^/]*$", ""))).withColumn(
        "media", text.media_dir(C("path"))
    ).withColumn("frame", text.frame_number(C("path")))


def pairs(spark: SparkSession, root: str, rgb: str = "MAX_*.JPG", infrared: str = "IRX_*.irg") -> DataFrame:
    """Frames that have both files, decided on the listings before anything is decoded."""
    a = inventory(spark, root, rgb).select("survey", "media", "frame", C("path").alias("rgb_path"))
    b = inventory(spark, root, infrared).select("survey", "media", "frame", C("path").alias("infrared_path"))
    return a.join(b, ["survey", "media", "frame"])


def decode_infrared(files: DataFrame, keys: list[str], width: int = 640, height: int = 512) -> DataFrame:
    """Raw files (keys, content) to (keys, raw array<int>, error): little-endian 16-bit body after any header.

    A file shorter than one raster has no raster, and says so in ``error``.
    """
    schema = ", ".join(f"{n} {t}" for n, t in files.select(*keys).dtypes) + ", raw array<int>, error string"
    body = width * height * 2

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [len(c) >= body for c in b["content"]]
            b["raw"] = [np.frombuffer(c[len(c) - body:], dtype="<u2").astype(np.int32) if w else None for c, w in zip(b["content"], whole)]
            b["error"] = [None if w else f"{len(c)} of {body} bytes" for c, w in zip(b["content"], whole)]
            yield b[[*keys, "raw", "error"]]

    return files.select(*keys, "content").mapInPandas(decode, schema)


#: Degrees Celsius between which a sea scene's readings are plausible.
PLAUSIBLE = (10.0, 40.0)


def _layouts(content: bytes, n: int) -> dict[str, np.ndarray]:
    """Every reading of the bytes as one raster of ``n`` pixels, in deci-kelvin: 16-bit after a header, 16-bit before a
    trailer, 32-bit floats in degrees before a trailer."""
    out = {}
    if len(content) >= 2 * n:
        out["headed16"] = np.frombuffer(content[len(content) - 2 * n:], "<u2").astype(np.int32)
    if len(content) > 2 * n:
        out["trailed16"] = np.frombuffer(content[:2 * n], "<u2").astype(np.int32)
    if len(content) >= 4 * n:
        degrees = np.frombuffer(content[:4 * n], "<f4").astype(float)
        usable = np.isfinite(degrees) & (np.abs(degrees) < 1e5)
        out["float32"] = np.where(usable, np.rint((np.where(usable, degrees, 0) + 273.15) * 10), -1).astype(np.int32)
    return out


def probe_infrared(files: DataFrame, keys: list[str], width: int = 640, height: int = 512) -> DataFrame:
    """Raw files (keys, content) of unknown layout to (keys, raw array<int>, layout, plausible, error).

    Each file takes the layout with the largest share of plausible readings (``plausible``; of equal ones the first of
    headed16, trailed16, float32). A float that is no number reads as -1. A file shorter than one raster, or null, has
    no raster, and says so in ``error``.
    """
    schema = ", ".join(f"{n} {t}" for n, t in files.select(*keys).dtypes) + ", raw array<int>, layout string, plausible double, error string"
    n = width * height
    low, high = ((t + 273.15) * 10 for t in PLAUSIBLE)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b["content"]:
                found = _layouts(c, n) if c is not None else {}
                share = {k: float(((v >= low) & (v <= high)).mean()) for k, v in found.items()}
                best = max(share, key=share.get, default=None)
                rows.append((found.get(best), best, share.get(best), None if best else f"{0 if c is None else len(c)} of {2 * n} bytes"))
            b["raw"], b["layout"], b["plausible"], b["error"] = zip(*rows) if rows else ((), (), (), ())
            yield b[[*keys, "raw", "layout", "plausible", "error"]]

    return files.select(*keys, "content").mapInPandas(decode, schema)


def encode_infrared(frames: DataFrame, keys: list[str], header: bytes = b"", trailer: bytes = b"") -> DataFrame:
    """(keys, raw array<int>, layout) to (keys, content): the bytes that ``probe_infrared`` reads back."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["content"] = [
                (np.asarray(r) / 10 - 273.15).astype("<f4").tobytes() + trailer if k == "float32" else header * (k == "headed16") + np.asarray(r, "<u2").tobytes() + trailer * (k != "headed16")
                for r, k in zip(b["raw"], b["layout"])
            ]
            yield b[[*keys, "content"]]

    schema = ", ".join(f"{n} {t}" for n, t in frames.select(*keys).dtypes) + ", content binary"
    return frames.select(*keys, "raw", "layout").mapInPandas(encode, schema)


def to_pixels(frames: DataFrame, keys: list[str], width: int = 640) -> DataFrame:
    """Arrays to pixel rows, hash-partitioned by the frame's keys while still compact."""
    p = frames.repartition(*keys).select(*keys, F.posexplode("raw").alias("pos", "raw"))
    return p.select(*keys, F.expr(f"cast(pos div {width} as int)").alias("y"), F.expr(f"cast(pos % {width} as int)").alias("x"), "raw")


def read_infrared(spark: SparkSession, root: str, width: int = 640, height: int = 512) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", "IRX_*.irg").option("recursiveFileLookup", "true").load(root)
    d = parse_paths(d.select("path", "content"))
    return to_pixels(decode_infrared(d, ["survey", "media", "frame"], width, height), ["survey", "media", "frame"], width)


def read_rgb(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images as (path, y, x, r, g, b), with one, three or four channels (grey, colour, colour and alpha).

    Bytes come as blue, green, red; they become one array a line in a vectorised step and are exploded last.
    """
    d = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    d = d.select(C("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, height, width, channels, data in batch.itertuples(index=False):
                image = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int32)
                r, g, b = (image[:, :, k if channels >= 3 else 0] for k in (2, 1, 0))
                yield pd.DataFrame({"path": path, "y": np.arange(height, dtype=np.int32), "r": list(r), "g": list(g), "b": list(b)})

    rows = d.mapInPandas(lines, "path string, y int, r array<int>, g array<int>, b array<int>")
    return rows.select("path", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("path", "y", "x", "p.r", "p.g", "p.b")


# ---- capture metadata --------------------------------------------------------------------------

# Tag numbers of the image and position directories.
_TAGS = {0x0132: "stamp", 0x0112: "orientation"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 6: "altitude", 15: "track", 17: "heading"}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 10: 8}
META = (
    "lat_ref string, lat_dms array<double>, lon_ref string, lon_dms array<double>, altitude double, track double, "
    "heading double, stamp string, orientation int, xmp string"
)


def _directory(b: bytes, base: int, at: int, e: str) -> dict:
    out = {}
    (n,) = struct.unpack_from(e + "H", b, base + at)
    for k in range(n):
        p = base + at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(e + "HHI", b, p)
        size = _SIZE.get(kind, 1) * count
        q = p + 8 if size <= 4 else base + struct.unpack_from(e + "I", b, p + 8)[0]
        if kind == 2:
            out[tag] = b[q : q + count].split(b"\0")[0].decode("latin-1")
        elif kind in (5, 10):
            v = struct.unpack_from(e + ("II" if kind == 5 else "ii") * count, b, q)
            out[tag] = [v[i] / v[i + 1] if v[i + 1] else None for i in range(0, len(v), 2)]
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(e + ("H" if kind == 3 else "I"), b, q)[0]
    return out


def _metadata(b: bytes) -> dict:
    """Tags of one file head; a file without them yields NULLs."""
    row: dict = dict.fromkeys([f.split()[0] for f in META.split(", ")])
    x = b.find(b"Camera:Yaw=")
    row["xmp"] = b[x : x + 40].decode("latin-1") if x >= 0 else None
    base = b.find(b"Exif\0\0")
    try:
        if base < 0:
            return row
        base += 6
        e = "<" if b[base : base + 2] == b"II" else ">"
        top = _directory(b, base, struct.unpack_from(e + "I", b, base + 4)[0], e)
        row.update({n: top.get(t) for t, n in _TAGS.items()})
        if 0x8825 in top:
            g = {n: v for t, n in _GPS.items() if (v := _directory(b, base, top[0x8825], e).get(t)) is not None}
            row.update(lat_ref=g.get("lat_ref"), lon_ref=g.get("lon_ref"), lat_dms=g.get("lat"), lon_dms=g.get("lon"))
            row.update({k: g[k][0] for k in ("altitude", "track", "heading") if k in g})
    except (struct.error, IndexError):
        pass
    return row


def _head(b: bytes) -> bytes:
    """The segments of a JPEG file before its image data, found by their lengths; any other file whole."""
    at = 2
    if b[:2] != b"\xff\xd8":
        return b
    while at + 4 <= len(b) and b[at] == 0xFF:
        if b[at + 1] == 0xDA:
            return b[:at]
        at += 2 + int.from_bytes(b[at + 2:at + 4], "big")
    return b  # no well-formed segments


def metadata(files: DataFrame, keys: list[str]) -> DataFrame:
    """Position, heading and time of (keys, content), from all segments before the image data."""
    schema = ", ".join(f"{n} {t}" for n, t in files.select(*keys).dtypes) + ", " + META

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tags = pd.DataFrame([_metadata(_head(bytes(c))) for c in b["content"]], index=b.index, dtype=object)
            yield pd.concat([b[keys], tags], axis=1)

    d = files.select(*keys, "content").mapInPandas(parse, schema)
    dms = lambda c, ref: geo.dms_to_decimal(C(c)[0], C(c)[1], C(c)[2], C(ref))
    return d.select(
        *keys,
        dms("lat_dms", "lat_ref").alias("lat"),
        dms("lon_dms", "lon_ref").alias("lon"),
        "altitude",
        F.coalesce("heading", text.xmp_heading(C("xmp"))).alias("heading"),
        F.when(C("heading").isNotNull(), "exif").when(C("xmp").isNotNull(), "xmp").alias("heading_source"),
        "track",
        text.exif_time(C("stamp")).alias("ts"),
        "orientation",
    )


# ---- documents ---------------------------------------------------------------------------------

LOCATION = "struct<frame:bigint,lat:double,lon:double,area_m2:double>"


def detection_records(doc: Column, schema: str = "struct<detections:array<struct<rgb_frame:string,datetime:string>>>") -> Column:
    return F.from_json(doc, schema)["detections"]


def location_records(doc: Column, key: str, item: str = LOCATION) -> Column:
    """Locations of a summary document: under the key, or the document itself when it is a list.

    A document cut off in the middle yields what the parser could still read.
    """
    listed = F.from_json(doc, f"array<{item}>")
    keyed = F.from_json(doc, f"struct<{key}:array<{item}>>", {"mode": "PERMISSIVE"})[key]
    return F.when(F.ltrim(doc).startswith("["), listed).otherwise(keyed)


def read_locations(spark: SparkSession, path: str, key: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True)
    return docs.select(F.inline(location_records(C("value"), key)))


PLACEMARK = (
    "name string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>, Point struct<coordinates:string>"
)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring) of every Placemark."""
    d = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").schema(PLACEMARK).load(path)
    return d.select("name", rings.parse_kml(C("Polygon.outerBoundaryIs.LinearRing.coordinates")).alias("ring"))


def parse_placemark(xml: Column) -> Column:
    return F.from_xml(xml, PLACEMARK, {"rowTag": "Placemark", "ignoreNamespace": "true"})


def read_training(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    d = spark.read.json(path, schema="frame bigint, x int, y int, label string, features array<double>", multiLine=True)
    return d.withColumn("features", array_to_vector("features"))
