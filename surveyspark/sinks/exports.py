"""GeoJSON, KML, CSV and JSON delivery.

Rows are rendered by Column expressions and written in parallel; KML parts are complete documents of a
bounded number of placemarks, GeoJSON is one Feature per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour, rings
from ..operators.ordered import with_index

C = F.col


def fixed(c: str | Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", (C(c) if isinstance(c, str) else c).cast("double"))


def geojson_feature(properties: dict[str, Column]) -> Column:
    """Polygon when the row has a ring, else a point."""
    coords = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    props = F.to_json(F.struct(*[c.alias(n) for n, c in properties.items()]))
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), F.when(C("ring").isNotNull(), poly).otherwise(point), F.lit(',"properties":'), props, F.lit("}")
    )


def write_geojson(d: DataFrame, path: str, properties: dict[str, Column]) -> None:
    d.select(geojson_feature(properties).alias("value")).write.mode("overwrite").text(path)


def csv_rows(d: DataFrame) -> DataFrame:
    return d.select(
        "frame",
        "datetime",
        C("lat").alias("centroid_lat"),
        C("lon").alias("centroid_lon"),
        fixed("area_m2", 2).alias("area_m2"),
        "area_pixels",
        fixed("anomaly", 2).alias("temperature_anomaly"),
        fixed("shore_distance", 1).alias("shore_distance"),
        fixed("altitude", 1).alias("altitude"),
        fixed(F.coalesce(C("eccentricity"), F.lit(0.0)), 3).alias("eccentricity"),
        F.when(C("ring").isNotNull(), "yes").otherwise("no").alias("has_polygon"),
    )


def write_csv(d: DataFrame, path: str) -> None:
    csv_rows(d).write.mode("overwrite").option("header", "true").csv(path)


def geometry(ring: Column) -> Column:
    body = F.concat(
        F.lit("<Polygon><extrude>0</extrude><altitudeMode>clampToGround</altitudeMode><outerBoundaryIs><LinearRing><coordinates>"),
        rings.to_kml(ring),
        F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"),
    )
    spot = F.concat(F.lit("<Point><coordinates>"), F.format_string("%.6f,%.6f,0", C("lon"), C("lat")), F.lit("</coordinates></Point>"))
    return F.when(F.size(ring) > 2, body).otherwise(spot)


def placemark(name: Column, lines: list[Column], style: Column, ring: Column) -> Column:
    return F.concat(
        F.lit("<Placemark><name>"), name, F.lit("</name><description><![CDATA["), F.concat_ws("\n", *lines),
        F.lit("]]></description><styleUrl>#"), style, F.lit("</styleUrl>"), geometry(ring), F.lit("</Placemark>"),
    )


def location_placemark() -> Column:
    return placemark(
        F.concat(F.lit("Location "), C("number").cast("string"), F.lit(" (Frame "), C("frame").cast("string"), F.lit(")")),
        [
            F.concat(F.lit("Frame: "), C("frame").cast("string")),
            F.concat(F.lit("Area: "), fixed("area_m2", 1), F.lit(" m²")),
            F.concat(F.lit("Temperature anomaly: "), fixed("anomaly", 1), F.lit("°C")),
        ],
        F.lit("plume"),
        C("ring"),
    )


def style(name: Column, kml_colour: Column) -> Column:
    return F.concat(
        F.lit('<Style id="'), name, F.lit('"><LineStyle><color>'), kml_colour, F.lit("</color><width>2</width></LineStyle><PolyStyle><color>"),
        kml_colour, F.lit("</color></PolyStyle></Style>"),
    )


def directory_colour(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in colour.DIRECTORY_COLOURS]), (position % len(colour.DIRECTORY_COLOURS) + 1).cast("int"))


def kml_documents(d: DataFrame, order: str, group: list[str] = (), styles: Column | None = None, per_document: int = 10000) -> DataFrame:
    """Rows (group, placemark, order) to complete documents of at most ``per_document`` placemarks."""
    idx = with_index(d.withColumn("_s", styles if styles is not None else F.lit("")), list(group), order)
    part = F.floor(C("idx") / per_document).alias("part")
    g = idx.groupBy(*group, part).agg(
        F.array_sort(F.collect_list(F.struct("idx", "placemark"))).alias("p"), F.array_join(F.array_sort(F.collect_set("_s")), "\n").alias("s")
    )
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n'
    body = F.array_join(F.transform("p", lambda e: e["placemark"]), "\n")
    return g.select(*group, "part", F.concat(F.lit(head), C("s"), F.lit("\n"), body, F.lit("\n</Document>\n</kml>")).alias("value"))


def write_kml(documents: DataFrame, path: str, group: list[str] = ()) -> None:
    """One file per document."""
    documents.select(*group, "part", "value").write.mode("overwrite").partitionBy(*group, "part").text(path)


def write_frame_products(px: DataFrame, path: str) -> None:
    """Masked temperatures as parquet, one folder per directory."""
    px.write.mode("overwrite").partitionBy("media").parquet(path)
