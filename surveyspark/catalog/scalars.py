"""Scalar functions evaluated over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Camera
from ..functions import colour, geo, rings, text, infrared
from ..operators import baseline as B
from ..sources.tables import captures, detections, pixels, table
from .base import query
from .baselines import hav_sql, hist, rounded

CAM = Camera()
C = F.col


@query("raw_to_celsius", "select frame, y, x, round(raw/10 - 273.15, 6) as temp from px")
def raw_to_celsius(spark, sf):
    return rounded(pixels(spark, sf).select("frame", "y", "x", infrared.celsius(C("raw")).alias("temp")))


_U = """select unit, round(avg(t),4) as mean_celsius, avg(t) between 10 and 40 as plausible from (
  select unnest(['centi_kelvin','deci_kelvin','ten_kelvin','fitted_scale']) as unit,
    unnest([raw/100e0-273.15, raw/10e0-273.15, raw*10e0-273.15, raw*(10e0/(hi-lo)) + (293 - lo*(10e0/(hi-lo))) - 273.15]) as t
  from px, (select min(raw) as lo, max(raw) as hi from px)) group by unit"""


@query("raw_to_celsius_centik", _U)
def unit_audit(spark, sf):
    """Mean temperature under each unit hypothesis, on the pooled histogram."""
    p = pixels(spark, sf).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    ends = p.agg(F.struct(F.min("raw").alias("lo"), F.max("raw").alias("hi"))).scalar()
    d = p.withColumn("e", ends).select(
        "n", F.inline(infrared.unit_hypotheses(C("raw"), C("e.lo").cast("double"), C("e.hi").cast("double")))
    )
    m = F.sum(C("celsius") * C("n")) / F.sum("n")
    return d.groupBy("unit").agg(F.round(m, 4).alias("mean_celsius"), m.between(10, 40).alias("plausible"))


@query(
    "raw_to_celsius_planck",
    """select frame, y, x, round((1428e0/ln(16384e0/((case when raw=0 then 1 else raw end)+7340e0)+1) - 273.15)*0.95, 6) as temp from px""",
)
def planck(spark, sf):
    return rounded(pixels(spark, sf).select("frame", "y", "x", infrared.celsius_planck(C("raw")).alias("temp")))


@query(
    "dms_to_decimal",
    """select frame, round(sgn*(d + m/60 + s/3600), 6) as lat from (select frame, case when lat<0 then -1 else 1 end as sgn,
      floor(abs(lat)) as d, floor((abs(lat)-floor(abs(lat)))*60) as m,
      ((abs(lat)-floor(abs(lat)))*60 - floor((abs(lat)-floor(abs(lat)))*60))*60 as s from captures)""",
)
def dms(spark, sf):
    a = F.abs("lat")
    m = (a - F.floor(a)) * 60
    ref = F.when(C("lat") < 0, "S").otherwise("N")
    return rounded(
        captures(spark, sf).select("frame", geo.dms_to_decimal(F.floor(a), F.floor(m), (m - F.floor(m)) * 60, ref).alias("lat"))
    )


@query("yaw_to_heading", "select frame, case when heading-180 < 0 then heading-180+360e0 else heading-180 end as heading from captures")
def yaw(spark, sf):
    return captures(spark, sf).select("frame", geo.yaw_to_heading((C("heading") - 180).cast("double")).alias("heading"))


@query(
    "capture_time",
    """select frame, strftime(ts, '%Y-%m-%d') as day, round(hour(ts) + minute(ts)/60e0, 6) as hour_utc,
      round((hour(ts) + 19) % 24 + minute(ts)/60e0, 6) as hour_wrapped, strftime(ts - interval 5 hour, '%Y-%m-%d %H:%M') as local_time from captures""",
)
def capture_time(spark, sf):
    stamp = text.exif_time(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    d = captures(spark, sf).select("frame", stamp.alias("t"))
    return d.select(
        "frame",
        F.date_format("t", "yyyy-MM-dd").alias("day"),
        F.round(text.decimal_hour(C("t")), 6).alias("hour_utc"),
        F.round(text.decimal_hour(C("t"), -5), 6).alias("hour_wrapped"),
        F.date_format(C("t") - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm").alias("local_time"),
    )


@query("haversine_m", f"select frame, round({hav_sql('lat','lon','-27.145e0','-109.435e0')}, 4) as d from captures")
def haversine(spark, sf):
    return captures(spark, sf).select("frame", F.round(geo.haversine_m(C("lat"), C("lon"), -27.145, -109.435), 4).alias("d"))


@query(
    "equirect_m",
    """select frame, round(sqrt(pow((-27.145e0-lat)*111320,2) + pow((-109.435e0-lon)*111320*cos(radians((lat-27.145e0)/2)),2)),4) as d from captures""",
)
def equirect(spark, sf):
    return captures(spark, sf).select("frame", F.round(geo.equirect_m(C("lat"), C("lon"), -27.145, -109.435), 4).alias("d"))


@query(
    "ground_geometry",
    """select frame, round(gw,6) as width_m, round(gw*512/640,6) as height_m, round(gw/640,6) as gsd_m
      from (select frame, 2*altitude*tan(radians(22.5)) as gw from captures)""",
)
def ground_geometry(spark, sf):
    a = C("altitude")
    return rounded(
        captures(spark, sf).select(
            "frame", geo.ground_width(a).alias("width_m"), geo.ground_height(a).alias("height_m"), geo.gsd(a).alias("gsd_m")
        )
    )


@query("gsd_sensor_model", "select frame, round(altitude*13.2/(10*4096),9) as gsd_x, round(altitude*8.8/(10*3072),9) as gsd_y from captures")
def gsd_sensor(spark, sf):
    a = C("altitude")
    return rounded(
        captures(spark, sf).select("frame", geo.gsd_sensor(a, 13.2, 4096).alias("gsd_x"), geo.gsd_sensor(a, 8.8, 3072).alias("gsd_y")), 9
    )


_RX, _RY = "(tx/640e0-0.5)*4096*{r}", "(ty/512e0-0.5)*3072*{r}"


@query(
    "infrared_to_rgb_xy",
    """select frame, y, x, round(2048 + dx, 4) as rgb_x, round(1536 + dy, 4) as rgb_y, round(2048 + dx*cos(radians(10)) - dy*sin(radians(10)),4) as rot_x,
      round(1536 + dx*sin(radians(10)) + dy*cos(radians(10)),4) as rot_y
      from (select frame, y, x, (x*80/640e0-0.5)*4096*0.7 as dx, (y*64/512e0-0.5)*3072*0.7 as dy from px)""",
)
def infrared_to_rgb(spark, sf):
    tx, ty = C("x") * 80, C("y") * 64
    a, b = geo.infrared_to_rgb_xy(tx, ty, CAM.crop_ratio)
    c, d = geo.infrared_to_rgb_xy(tx, ty, CAM.crop_ratio, 10.0)
    return rounded(
        pixels(spark, sf).select("frame", "y", "x", a.alias("rgb_x"), b.alias("rgb_y"), c.alias("rot_x"), d.alias("rot_y")), 4
    )


def _latlon_sql(east, north, sign):
    e = f"(({east})*cos(radians({sign}heading)) - ({north})*sin(radians({sign}heading)))"
    n = f"(({east})*sin(radians({sign}heading)) + ({north})*cos(radians({sign}heading)))"
    return f"round(lat + {n}/111320, 8) as plat, round(lon + {e}/(111320*cos(radians(lat))), 8) as plon"


_G = "(2*altitude*tan(radians(22.5))/640)"


@query(
    "pixel_to_latlon",
    f"select frame, {_latlon_sql(f'(frame % 640 - 320)*{_G}', f'-(frame % 512 - 256)*{_G}', '-')} from captures",
)
def pixel_to_latlon(spark, sf):
    la, lo = geo.pixel_to_latlon(C("frame") % 640, C("frame") % 512, C("lat"), C("lon"), C("altitude"), C("heading"))
    return rounded(captures(spark, sf).select("frame", la.alias("plat"), lo.alias("plon")), 8)


def _rgbmodel_sql(name, fx, fy, gx, gy, rotates=True):
    e, n = f"(frame%640/640e0-0.5)*4096*{fx}*{gx}", f"-(frame%512/512e0-0.5)*3072*{fy}*{gy}"
    if not rotates:
        return f"select frame, '{name}' as model, round(lat + {n}/111320,8) as plat, round(lon + {e}/(111320*cos(radians(lat))),8) as plon from captures"
    return f"select frame, '{name}' as model, {_latlon_sql(e, n, '')} from captures"


_G80, _G75 = "(2*altitude*tan(radians(40))/4096)", "(2*altitude*tan(radians(37.5))/4096)"


@query(
    "pixel_to_latlon_rgbmodel",
    " union all ".join(
        [
            _rgbmodel_sql("fov80", "0.7", "0.7", _G80, _G80),
            _rgbmodel_sql("fov75", "0.7", "0.7", _G75, _G75),
            _rgbmodel_sql("sensor", "(640/4096e0)", "(512/3072e0)", "(altitude*13.2/40960)", "(altitude*8.8/30720)"),
            _rgbmodel_sql("flat", "1", "1", "(altitude*0.0001)", "(altitude*0.0001)", False),
        ]
    ),
)
def pixel_to_latlon_rgb(spark, sf):
    """All models in one pass over the frames."""
    models = []
    for m in ("fov80", "fov75", "sensor", "flat"):
        la, lo = geo.pixel_to_latlon_rgb(C("frame") % 640, C("frame") % 512, C("lat"), C("lon"), C("altitude"), C("heading"), m)
        models.append(F.struct(F.lit(m).alias("model"), F.round(la, 8).alias("plat"), F.round(lo, 8).alias("plon")))
    return captures(spark, sf).select("frame", F.inline(F.array(*models)))


def _corner_sql(i, sx, sy):
    return f"""select frame, {i} as corner, round(lon + (({sx}*hw)*cos(radians(-heading)) - ({sy}*hh)*sin(radians(-heading)))/(111320*cos(radians(lat))), 8) as clon,
      round(lat + (({sx}*hw)*sin(radians(-heading)) + ({sy}*hh)*cos(radians(-heading)))/111320, 8) as clat
      from (select *, altitude*tan(radians(22.5)) as hw, altitude*tan(radians(22.5))*512/640 as hh from captures)"""


@query(
    "footprint_corners",
    " union all ".join(_corner_sql(i, *s) for i, s in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)])),
)
def footprint_corners(spark, sf):
    ring = geo.footprint_corners(C("lat"), C("lon"), C("altitude"), C("heading"))
    d = captures(spark, sf).select("frame", F.posexplode(ring).alias("corner", "p"))
    return d.select("frame", "corner", F.round("p.lon", 8).alias("clon"), F.round("p.lat", 8).alias("clat"))


@query("sql_functions", f"""select c.frame, round({hav_sql('lat','lon','-27.145e0','-109.435e0')}, 4) as great_circle,
  round(sqrt(pow((-27.145e0-lat)*111320,2) + pow((-109.435e0-lon)*111320*cos(radians((lat-27.145e0)/2)),2)),4) as planar, p.plat, p.plon, n.north
  from captures c join (select frame, {_latlon_sql(f'(frame % 640 - 320)*{_G}', f'-(frame % 512 - 256)*{_G}', '-')} from captures) p using (frame) join (select frame, max(clat) as north from ({" union all ".join(_corner_sql(i, *s) for i, s in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)]))}) group by frame) n using (frame)""")
def sql_functions(spark, sf):
    """A statement that uses nothing but SQL and the session's registered functions."""
    from ..functions.sql import register

    register(spark)
    return spark.sql(
        """SELECT frame, round(d, 4) AS great_circle, round(p, 4) AS planar, round(place.lat, 8) AS plat, round(place.lon, 8) AS plon, round(north, 8) AS north FROM (
             SELECT frame, d, p, place, max(f.lat) AS north
             FROM (SELECT *, haversine_m(lat, lon, -27.145D, -109.435D) AS d, equirect_m(lat, lon, -27.145D, -109.435D) AS p,
                     pixel_to_latlon(frame % 640, frame % 512, lat, lon, altitude, heading) AS place FROM {captures}) c, LATERAL footprint_corners(c.lat, c.lon, altitude, heading) f
             GROUP BY frame, d, p, place)""",
        captures=captures(spark, sf),
    )


def squares(spark, sf):
    return detections(spark, sf).withColumn("ring", rings.square(C("lon"), C("lat"), C("half")))


@query(
    "polygon_area_m2",
    "select frame, round(4*half*half*111320*111320*cos(radians((3*(lat-half) + 2*(lat+half))/5)),4) as area from dets",
)
def polygon_area(spark, sf):
    return squares(spark, sf).select("frame", F.round(rings.area_m2(C("ring")), 4).alias("area"))


@query("polygon_area_deg", "select frame, round(4*half*half*111000*111000, 4) as area from dets")
def polygon_area_deg(spark, sf):
    return squares(spark, sf).select("frame", F.round(rings.area_deg_m2(C("ring")), 4).alias("area"))


@query("polygon_centroid", "select frame, round(lon,8) as clon, round(lat,8) as clat from dets")
def polygon_centroid(spark, sf):
    d = squares(spark, sf).withColumn("c", rings.centroid(C("ring")))
    return d.select("frame", F.round("c.lon", 8).alias("clon"), F.round("c.lat", 8).alias("clat"))


@query(
    "normalise_ring",
    """select frame, case when frame % 3 = 0 then null else 5 end as n_points, case when frame % 3 = 0 then null else true end as closed,
      case when frame % 3 = 0 then null else round(lon + case when frame % 3 = 1 then -half else -half end, 8) end as first_lon from dets""",
)
def normalise_ring(spark, sf):
    """Clockwise pair lists, counter-clockwise objects and two-point strays, all read to one layout."""
    pair = lambda a, b: F.array((C("lon") + C("half") * a), (C("lat") + C("half") * b))
    obj = lambda a, b: geo.point(C("lon") + C("half") * a, C("lat") + C("half") * b)
    clockwise = F.to_json(F.array(pair(-1, -1), pair(-1, 1), pair(1, 1), pair(1, -1)))
    objects = F.to_json(F.array(obj(-1, -1), obj(1, -1), obj(1, 1), obj(-1, 1)))
    short = F.to_json(F.array(pair(-1, -1), pair(1, 1)))
    k = C("frame") % 3
    d = detections(spark, sf).withColumn("j", F.when(k == 0, short).when(k == 1, clockwise).otherwise(objects))
    d = d.withColumn("ring", rings.normalise(C("j")))
    return d.select(
        "frame",
        F.when(C("ring").isNotNull(), F.size("ring")).alias("n_points"),
        (C("ring")[0] == F.element_at("ring", -1)).alias("closed"),
        F.round(C("ring")[0]["lon"], 8).alias("first_lon"),
    )


@query("decimate_ring", "select frame, 3 as n_even, 5 as n_all from dets")
def decimate_ring(spark, sf):
    n = F.size("ring")
    return squares(spark, sf).select(
        "frame",
        F.size(rings.decimate(C("ring"), 2)).alias("n_even"),
        F.size(rings.decimate(C("ring"), F.greatest(F.lit(1), F.floor(n / 20).cast("int")))).alias("n_all"),
    )


@query(
    "ring_bbox",
    "select frame, round(min_lon,8) as min_lon, round(max_lon,8) as max_lon, round(min_lat,8) as min_lat, round(max_lat,8) as max_lat from boxes",
)
def ring_bbox(spark, sf):
    return rounded(squares(spark, sf).select("frame", rings.bbox(C("ring")).alias("b")).select("frame", "b.*"), 8)


_AREA = """case when s = '' then 'unnamed_area' else s end as area from (select {k}, regexp_replace(replace(replace(replace(replace(replace(lower({leaf}),'flight ',''),
  'flight_',''),' - ','_'),'-','_'),' ','_'), '[^a-z0-9_]', '', 'g') as s from {t})"""


@query("area_name", f"select p_partkey, {_AREA.format(k='p_partkey', leaf=chr(39)+'Flight '+chr(39)+' || p_partkey % 10 || '+chr(39)+' - '+chr(39)+' || p_name', t='part')}")
def area_name(spark, sf):
    path = F.concat(F.lit("/surveys/Flight "), (C("p_partkey") % 10).cast("string"), F.lit(" - "), "p_name", F.lit("/100MEDIA"))
    return table(spark, sf, "part").select("p_partkey", text.area_name(path).alias("area"))


_HSV = """case when mx=mn then 0 when mx=r then 60*(case when (g-b)/(mx-mn) < 0 then (g-b)/(mx-mn)+6 else (g-b)/(mx-mn) end)
  when mx=g then 60*((b-r)/(mx-mn)+2) else 60*((r-g)/(mx-mn)+4) end as h,
  case when mx=0 then 0 else (mx-mn)/mx*255 end as s, mx as v"""
PXC = f"""(select *, {_HSV} from (select p.*, greatest(r,g,b)::double as mx, least(r,g,b)::double as mn,
  case when r>0 and g>0 then b::double/greatest(r,g) else 0 end as dom from px p))"""


@query("rgb_to_hsv", f"select frame, y, x, round(h,6) as h, round(s,6) as s, round(v,6) as v from {PXC}")
def rgb_to_hsv(spark, sf):
    h = colour.hsv(C("r"), C("g"), C("b"))
    return rounded(pixels(spark, sf).select("frame", "y", "x", *[c.alias(n) for n, c in h.items()]))


def _lin(c):
    return f"(case when {c}/255e0 > 0.04045 then pow(({c}/255e0+0.055)/1.055, 2.4) else {c}/255e0/12.92 end)"


def _f(t):
    return f"(case when {t} > 0.008856 then pow({t}, 1/3e0) else 7.787*{t} + 16/116e0 end)"


LABX = f"""(select *, 116*{_f('yy')}-16 as l, 500*({_f('xx')}-{_f('yy')}) as a, 200*({_f('yy')}-{_f('zz')}) as lb from (
  select *, (0.412453e0*lr+0.357580e0*lg+0.180423e0*lbb)/0.95047e0 as xx, 0.212671e0*lr+0.715160e0*lg+0.072169e0*lbb as yy,
    (0.019334e0*lr+0.119193e0*lg+0.950227e0*lbb)/1.08883e0 as zz from (
    select *, {_lin('r')} as lr, {_lin('g')} as lg, {_lin('b')} as lbb from {PXC})))"""


@query("rgb_to_lab", f"select frame, y, x, round(l,5) as l, round(a,5) as a, round(lb,5) as lb from {LABX}")
def rgb_to_lab(spark, sf):
    h = colour.lab(C("r"), C("g"), C("b"))
    return rounded(pixels(spark, sf).select("frame", "y", "x", *[c.alias(n) for n, c in h.items()]), 5)


@query(
    "colour_features",
    """select frame, y, x, round((r+g+b)/3e0,6) as intensity, round(case when r>0 and g>0 then b/greatest(r,g)::double else 0 end,6) as dominance,
      round(case when r>0 or g>0 then b/(greatest(r,g)+1e0) else 0 end,6) as dominance_guarded, (greatest(r,g,b)-least(r,g,b))::double as colour_range from px""",
)
def colour_features(spark, sf):
    r, g, b = C("r"), C("g"), C("b")
    return rounded(
        pixels(spark, sf).select(
            "frame",
            "y",
            "x",
            colour.intensity(r, g, b).alias("intensity"),
            colour.blue_dominance(r, g, b).alias("dominance"),
            colour.blue_dominance(r, g, b, 1.0).alias("dominance_guarded"),
            colour.colour_range(r, g, b).alias("colour_range"),
        )
    )


@query(
    "advanced_features",
    """select frame, y, x, round(case when g>0 then r/g::double else 0 end,6) as rg, round(case when b>0 then r/b::double else 0 end,6) as rb,
      round(case when b>0 then g/b::double else 0 end,6) as gb, round(case when g>0 then b/g::double else 0 end,6) as bg,
      (b-greatest(r,g))::double as blue_excess, pow(b-greatest(r,g),2)::double as blue_excess_sq, (greatest(r,g,b)-least(r,g,b))::double as chroma,
      round(r/(r+g+b+1e-6),6) as r_norm, round(g/(r+g+b+1e-6),6) as g_norm, round(b/(r+g+b+1e-6),6) as b_norm from px""",
)
def advanced_features(spark, sf):
    f = colour.advanced(C("r"), C("g"), C("b"))
    return rounded(pixels(spark, sf).select("frame", "y", "x", *[c.alias(n) for n, c in f.items()]))


@query(
    "luminance",
    "select frame, y, x, round(0.2989e0*r+0.5870e0*g+0.1140e0*b,6) as lum, round((r+g+b)/3e0,6) as mean, round(0.2125e0*r+0.7154e0*g+0.0721e0*b,6) as gray from px",
)
def luminance(spark, sf):
    r, g, b = C("r"), C("g"), C("b")
    return rounded(
        pixels(spark, sf).select(
            "frame",
            "y",
            "x",
            colour.luminance(r, g, b).alias("lum"),
            colour.luminance(r, g, b, "mean").alias("mean"),
            colour.luminance(r, g, b, "709").alias("gray"),
        )
    )


COLS = ", ".join(f"({k}e0,'{n}','{c}')" for k, n, c in colour.THRESHOLD_COLOURS)


@query(
    "threshold_colour",
    f"""select frame, t, case when d < 0.1 then name when t < 0.25 then 'white' when t > 4 then 'darkblack' else name end as name,
      case when d < 0.1 then kml when t < 0.25 then '7fffffff' when t > 4 then '7f000000' else kml end as kml from (
      select frame, t, d, name, kml, row_number() over (partition by frame order by d, k) as rk from (
        select frame, t, abs(k - t) as d, k, name, kml from (select frame, (frame % 47) * 0.1e0 as t from dets), (values {COLS}) v(k, name, kml)))
      where rk = 1""",
)
def threshold_colour(spark, sf):
    d = detections(spark, sf).select("frame", ((C("frame") % 47) * F.lit(0.1)).alias("t"))
    return d.withColumn("c", colour.threshold_colour(C("t"))).select("frame", "t", "c.name", "c.kml")


@query("threshold_series", "select frame, i, 0.5e0 + i * 0.5e0 as threshold from dets, (select unnest(range(4)) as i)")
def threshold_series(spark, sf):
    d = detections(spark, sf).select("frame", F.posexplode(text.threshold_series(0.5, 0.5, 4)).alias("i", "threshold"))
    return d


@query(
    "location_hash",
    "select frame, md5(printf('%.6f,%.6f', lon+2e-7, lat+2e-7)) as h6, md5(printf('%.5f,%.5f', lat+2e-7, lon+2e-7)) as h5 from dets",
)
def location_hash(spark, sf):
    la, lo = C("lat") + F.lit(2e-7), C("lon") + F.lit(2e-7)
    return detections(spark, sf).select(
        "frame", text.location_hash(la, lo).alias("h6"), text.location_hash(la, lo, 5, "latlon").alias("h5")
    )


@query(
    "frame_overlap",
    f"""select frame, round(d,4) as distance_m, round(case when d>=gw then 0 else gw-d end,4) as overlap_m,
      round(case when d>=gw then 0 else (gw-d)/gw*100 end,4) as overlap_pct, cast(floor(case when d>=gw then 0 else gw-d end/(gw/640)) as bigint) as overlap_px
      from (select frame, {hav_sql('lat','lon','-27.145e0','-109.435e0')} as d, 2*altitude*tan(radians(22.5)) as gw from captures)""",
)
def frame_overlap(spark, sf):
    d = captures(spark, sf).select(
        "frame", geo.haversine_m(C("lat"), C("lon"), -27.145, -109.435).alias("distance_m"), geo.ground_width(C("altitude")).alias("gw")
    )
    o = geo.overlap(C("distance_m"), C("gw"))
    return rounded(d.select("frame", "distance_m", *[c.alias(n) for n, c in o.items()]), 4)


@query(
    "edge_flags",
    """select frame, y, x, concat_ws(',', case when x < 1 then 'left' end, case when x > 7-1 then 'right' end,
      case when y < 1 then 'top' end, case when y > 7-1 then 'bottom' end) as edges from px""",
)
def edge_flags(spark, sf):
    e = F.concat_ws(",", text.near_edges(C("x"), C("y"), 7, 7, 1))
    return pixels(spark, sf).select("frame", "y", "x", e.alias("edges"))


@query(
    "interpret_effect",
    """select frame, case when p<0.001 then 'highly significant (p < 0.001)' when p<0.01 then 'significant (p < 0.01)' when p<0.05 then 'significant (p < 0.05)'
      else 'not significant (p ≥ 0.05)' end as significance, case when v<0.1 then 'negligible' when v<0.3 then 'small' when v<0.5 then 'medium' else 'large' end as effect
      from (select frame, (frame % 100)/1000e0 as p, (frame % 7)/10e0 as v from dets)""",
)
def interpret_effect(spark, sf):
    p, v = (C("frame") % 100) / F.lit(1000.0), (C("frame") % 7) / F.lit(10.0)
    return detections(spark, sf).select("frame", text.significance(p).alias("significance"), text.effect_size(v).alias("effect"))


@query(
    "minmax_norm",
    """select frame, y, x, round((raw-lo)/(hi-lo)::double,6) as norm, round((raw-lo)/(hi-lo+1e-10),6) as norm_guarded from (
      select *, min(raw) over (partition by frame) as lo, max(raw) over (partition by frame) as hi from px)""",
)
def minmax_norm(spark, sf):
    p = pixels(spark, sf, colocate=["frame"])
    return rounded(
        p.select(
            "frame",
            "y",
            "x",
            infrared.minmax_norm(C("raw"), ["frame"]).alias("norm"),
            infrared.minmax_norm(C("raw"), ["frame"], 1e-10).alias("norm_guarded"),
        )
    )


_NAMES = ["North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest"]


@query(
    "offset_bearing",
    f"""select frame, round(ang,4) as bearing, {list(_NAMES)}[cast(floor(((ang+22.5) % 360)/45) as int)+1] as compass from (
      select frame, (degrees(atan2((lon+109.435e0)*111320*cos(radians(-27.145e0)), (lat+27.145e0)*111320))+360) % 360 as ang from captures)""",
)
def offset_bearing(spark, sf):
    north = (C("lat") - F.lit(-27.145)) * F.lit(111320.0)
    east = (C("lon") - F.lit(-109.435)) * F.lit(111320.0) * F.cos(F.radians(F.lit(-27.145)))
    ang = geo.bearing(north, east)
    return captures(spark, sf).select("frame", F.round(ang, 4).alias("bearing"), geo.compass(ang).alias("compass"))


@query(
    "centre_crop_xy",
    "select frame, y-1 as y, x-1 as x, r, g, b from px where y between 1 and 6 and x between 1 and 6",
)
def centre_crop(spark, sf):
    return crop_centre(pixels(spark, sf), 8, 8, 0.7).select("frame", "y", "x", "r", "g", "b")


def crop_centre(px, width, height, ratio):
    """Pixels inside the centred crop, re-based to its corner."""
    ox, oy = int(width * (1 - ratio) / 2), int(height * (1 - ratio) / 2)
    inside = C("x").between(ox, width - 1 - ox) & C("y").between(oy, height - 1 - oy)
    return px.filter(inside).withColumn("x", C("x") - ox).withColumn("y", C("y") - oy)


@query(
    "parse_kml_coords",
    "select frame, 5 as n_points, round(lon-half,6) as first_lon, round(lat+half,6) as max_lat from dets",
)
def parse_kml_coords(spark, sf):
    d = squares(spark, sf).withColumn("t", rings.to_kml(C("ring"), "%.9f,%.9f,0")).withColumn("k", rings.parse_kml(C("t")))
    return d.select(
        "frame",
        F.size("k").alias("n_points"),
        F.round(C("k")[0]["lon"], 6).alias("first_lon"),
        F.round(F.array_max(F.transform("k", lambda p: p["lat"])), 6).alias("max_lat"),
    )
