"""Mask algebra, neighbourhood operators, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import aggregates as A
from ..operators import raster, regions
from ..operators.graph import connected_components
from ..sources.tables import H, W, pixels, wide_pixels
from .base import query
from .baselines import KEYS as MF
from .baselines import hist, rounded
from .scalars import LABX
from .views import COLD, LAND, MOMENTS, OCEAN, PROPS, PXALL, WAVES, components, dilated, eroded, eroded_open_border

C = F.col
K = ["frame"]
PX = ["frame", "y", "x"]


def dense(spark, sf):
    return pixels(spark, sf, colocate=["frame"])


def mask(spark, sf, name):
    return dense(spark, sf).filter(name).select(*PX)


def cold(spark, sf):
    """Ocean pixels half a degree below their frame's median."""
    p = dense(spark, sf).filter("ocean")
    m = p.groupBy("frame").agg(F.percentile("raw", F.lit(0.5)).alias("m"))
    return p.join(m, "frame").filter(C("raw") < C("m") - 5)


# ---- masks -------------------------------------------------------------------------------------


@query("mask_union", f"select * from ({COLD}) union {WAVES}")
def mask_union(spark, sf):
    return cold(spark, sf).select(*PX).union(mask(spark, sf, "waves")).distinct()


@query("mask_intersect", f"select * from ({dilated(LAND, 1)}) intersect {OCEAN}")
def mask_intersect(spark, sf):
    return raster.dilate(mask(spark, sf, "land"), K, 1, W, H).intersect(mask(spark, sf, "ocean"))


@query("mask_except", f"{PXALL} except {OCEAN}")
def mask_except(spark, sf):
    p = dense(spark, sf)
    return regions.complement(mask(spark, sf, "ocean"), p.select("frame").distinct(), K, W, H)


@query("dilate_disk", dilated(LAND, 2))
def dilate_disk(spark, sf):
    return raster.dilate(mask(spark, sf, "land"), K, 2, W, H)


@query("dilate_dense", dilated(LAND, 2))
def dilate_dense(spark, sf):
    return raster.dilate_dense(dense(spark, sf), "land", K, 2, "near").filter("near").select(*PX)


@query("erode_disk", eroded(OCEAN, 1))
def erode_disk(spark, sf):
    return raster.erode(mask(spark, sf, "ocean"), K, 1, W, H)


@query("open_disk", dilated(eroded_open_border(OCEAN, 1), 1))
def open_disk(spark, sf):
    p = dense(spark, sf)
    return raster.open_(mask(spark, sf, "ocean"), K, 1, W, H, p.select("frame").distinct())


@query("close_disk", eroded_open_border(dilated(LAND, 2), 2))
def close_disk(spark, sf):
    p = dense(spark, sf)
    return raster.close(mask(spark, sf, "land"), K, 2, W, H, p.select("frame").distinct())


@query("shoreline", "select frame, y, x from shore")
def shoreline(spark, sf):
    return raster.shoreline(*[mask(spark, sf, m) for m in ("ocean", "land", "waves")], K, W, H)


@query("shore_distance", "select frame, y, x, round(d, 6) as distance from dist join px using (frame, y, x) where ocean")
def shore_distance(spark, sf):
    from ..plans.detect import with_shore

    return with_shore(dense(spark, sf), K).filter("ocean").select(*PX, F.round("distance", 6).alias("distance"))


@query("shore_distance_wide", "select frame, y, x, round(d, 6) as distance from wide_dist where not land")
def shore_distance_wide(spark, sf):
    """Distances far beyond any neighbourhood: one shore in the corner of each raster."""
    from ..plans.detect import with_shore

    return with_shore(wide_pixels(spark, sf), K).filter("ocean").select(*PX, F.round("distance", 6).alias("distance"))


@query(
    "cold_by_shore_band",
    """select frame, cast(floor(d / 10) as int) as band, count(*) as n, round(avg(d), 6) as mean_distance, round(sum(exp(-d / 20)), 6) as weight
    from wide_dist join wide_med using (frame) where not land and raw < m - 5 and d is not null group by all""",
)
def cold_by_shore_band(spark, sf):
    """Cold ocean pixels by ten-pixel bands of shore distance, with the weight that confidence gives them."""
    from ..plans.detect import with_shore

    p = with_shore(wide_pixels(spark, sf), K).filter("ocean")
    m = p.groupBy("frame").agg(F.percentile("raw", F.lit(0.5)).alias("m"))
    d = p.join(m, "frame").filter((C("raw") < C("m") - 5) & C("distance").isNotNull())
    return d.groupBy("frame", F.floor(C("distance") / 10).cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.sum(F.exp(-C("distance") / 20)), 6).alias("weight")
    )


# ---- regions -----------------------------------------------------------------------------------


@query("label_regions", "select frame, y, x, region from cold8")
def label_regions(spark, sf):
    return regions.label_regions(cold(spark, sf), K, W)


@query("label_regions_4conn", "select frame, y, x, region from land4")
def label_regions4(spark, sf):
    return regions.label_regions(mask(spark, sf, "land"), K, W, 4)


@query("connected_components", "select frame*64 + y*8 + x as node, frame*64 + region as component from cold8 where (frame, region) in (select frame, region from cold8 group by all having count(*) > 1)")
def components_query(spark, sf):
    """The same regions found by star contraction over the pixel adjacency graph."""
    c = cold(spark, sf).select(*PX)
    node = C("frame") * 64 + C("y") * 8 + C("x")
    offs = F.array(*[F.struct((C("y") + a).alias("y"), (C("x") + b).alias("x")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    to = c.select("frame", node.alias("src"), F.inline(offs))
    return connected_components(to.join(c, PX).select("src", node.alias("dst")))


@query("remove_small_objects", "select frame, y, x from cold8 qualify count(*) over (partition by frame, region) >= 3")
def remove_small_objects(spark, sf):
    return regions.remove_small_objects(cold(spark, sf), K, W, 3, 8)


_HOLE = ", ".join(f"{n} AS ({s})" for n, s in components("bg", f"{PXALL} except {OCEAN}", 4).items())


@query(
    "remove_small_holes",
    f"WITH {_HOLE} {OCEAN} union (select frame, y, x from bg qualify count(*) over (partition by frame, region) < 3)",
)
def remove_small_holes(spark, sf):
    p = dense(spark, sf)
    return regions.remove_small_holes(mask(spark, sf, "ocean"), p.select("frame").distinct(), K, W, H, 3)


_BIG = """select frame, y, x from ocean8 join (select frame, region from (select frame, region, count(*) as c,
  row_number() over (partition by frame order by count(*) desc, region) as rk from ocean8 group by frame, region)
  where rk = 1 and c > 0.5*64) using (frame, region)"""


@query("largest_component", _BIG)
def largest_component(spark, sf):
    return regions.largest_component(mask(spark, sf, "ocean"), K, W, H, 0.5)


@query(
    "region_props",
    f"""select frame, region, area, round(cy,6) as cy, round(cx,6) as cx, min_y, min_x, max_y, max_x, round(eccentricity,5) as eccentricity from (
      select *, {PROPS.split(',', 7)[7]} from (select frame, region, {MOMENTS} from cold8 group by frame, region))""",
)
def region_props(spark, sf):
    p = regions.region_props(regions.label_regions(cold(spark, sf), K, W), K)
    return p.select(
        "frame", "region", "area", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"), "min_y", "min_x", "max_y", "max_x",
        F.round("eccentricity", 5).alias("eccentricity"),
    )


@query(
    "region_temps",
    """select frame, region, round(avg(raw)/10-273.15,6) as mean_temp, round(min(raw)/10-273.15,6) as min_temp, round(max(raw)/10-273.15,6) as max_temp,
      round((avg(raw)-any_value(m))/10,6) as anomaly, round((any_value(m)-avg(raw))/10,6) as anomaly_inverted
      from cold8 join cold using (frame, y, x) group by frame, region""",
)
def region_temps(spark, sf):
    lab = regions.label_regions(cold(spark, sf), K, W, carry=["raw", "m"])
    a = (F.avg("raw") - F.first("m")) / 10
    d = lab.groupBy("frame", "region").agg(*regions.temperature_columns(), a.alias("anomaly"), (-a).alias("anomaly_inverted"))
    return rounded(d)


@query(
    "region_touches_edge",
    """select frame, region, max(y<1 or y>6 or x<1 or x>6) as is_edge, concat_ws(',', case when max(y<1) then 'top' end, case when max(y>6) then 'bottom' end,
      case when max(x<1) then 'left' end, case when max(x>6) then 'right' end) as edges from cold8 group by frame, region""",
)
def region_touches_edge(spark, sf):
    from ..plans.detect import is_edge

    lab = regions.label_regions(cold(spark, sf), K, W)
    d = lab.groupBy("frame", "region").agg(*regions.edge_columns(W, H, 1))
    return d.select("frame", "region", is_edge().alias("is_edge"), F.concat_ws(",", regions.edges_touched()).alias("edges"))


@query("largest_plume", """select frame, region, area from (select frame, region, count(*) as area,
  row_number() over (partition by frame order by count(*) desc, region) as rk from cold8 group by frame, region) where rk = 1""")
def largest_plume(spark, sf):
    s = regions.region_sizes(regions.label_regions(cold(spark, sf), K, W), K)
    t = F.max_by(F.struct("region", "area"), F.struct("area", -C("region")))
    return s.groupBy("frame").agg(t.alias("t")).select("frame", "t.region", "t.area")


@query(
    "region_outline",
    """select c.frame, c.region, count(*) as area_px, sum(4 - (select count(*) from cold8 n where n.frame = c.frame and n.region = c.region
       and abs(n.y-c.y)+abs(n.x-c.x) = 1)) as border_sides, true as closed from cold8 c group by all""",
)
def region_outline(spark, sf):
    """Boundary sides counted relationally against every ring's closure."""
    lab = regions.label_regions(cold(spark, sf), K, W)
    ring = regions.outline(lab, K, W).select("frame", "region", (C("ring")[0] == F.element_at("ring", -1)).alias("closed"))
    k = ["frame", "region"]
    four = F.array(*[F.struct((C("y") + a).alias("y"), (C("x") + b).alias("x")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    inner = lab.select(*k, F.inline(four)).join(lab, [*k, "y", "x"], "left_semi").groupBy(*k).agg(F.count(F.lit(1)).alias("i"))
    n = lab.groupBy(*k).agg(F.count(F.lit(1)).alias("area_px")).join(inner, k, "left")
    n = n.select(*k, "area_px", (C("area_px") * 4 - F.coalesce("i", F.lit(0))).alias("border_sides"))
    return n.join(ring, k)


# ---- dense neighbourhoods ----------------------------------------------------------------------


def _mirror_sql(r):
    """Pixels repeated at their mirrored positions up to r outside the frame."""
    spots = lambda a: f"unnest(list_filter([{a}, -1-{a}, 15-{a}, {a}-16, {a}+16, -17-{a}, 31-{a}], lambda p: p >= -{r} and p < 8+{r}))"
    return f"(select frame, yy, {spots('x')} as xx, raw from (select frame, {spots('y')} as yy, x, raw from px))"


def _box_sql(r, what):
    return f"""select p.frame, p.y, p.x, {what} from px p join {_mirror_sql(r)} q
      on q.frame = p.frame and abs(q.yy - p.y) <= {r} and abs(q.xx - p.x) <= {r} group by p.frame, p.y, p.x"""


@query("box_filter", _box_sql(1, "round(avg(q.raw),6) as mean"))
def box_filter(spark, sf):
    return rounded(raster.box_filter(dense(spark, sf), "raw", K, 1, W, H))


@query(
    "box_filter_shrink",
    """select p.frame, p.y, p.x, round(avg(q.raw),6) as mean from px p join px q
      on q.frame = p.frame and abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1 group by p.frame, p.y, p.x""",
)
def box_filter_shrink(spark, sf):
    return rounded(raster.box_filter(dense(spark, sf), "raw", K, 1, W, H, "shrink"))


@query(
    "local_variance",
    f"""select frame, y, x, round(variance,8) as variance, round((variance-min(variance) over w)/(max(variance) over w-min(variance) over w),12) as variance_norm
      from ({_box_sql(2, 'var_pop(q.raw-2950e0) as variance')}) window w as (partition by frame)""",
)
def local_variance(spark, sf):
    from ..plans.segment import normalised

    d = raster.local_stats(dense(spark, sf), "raw", K, 2, W, H, shift=2950.0).drop("mean")
    d = normalised(d, "variance", K)
    return d.select(*PX, F.round("variance", 8).alias("variance"), F.round("variance_norm", 12).alias("variance_norm"))


SOBEL = """select frame, y, x, (coalesce(lag(dx) over cy, dx) + 2*dx + coalesce(lead(dx) over cy, dx))::bigint as gx,
  (coalesce(lead(sx) over cy, sx) - coalesce(lag(sx) over cy, sx))::bigint as gy from (
    select frame, y, x, coalesce(lead(raw) over cx, raw) - coalesce(lag(raw) over cx, raw) as dx, coalesce(lead(raw) over cx, raw) + coalesce(lag(raw) over cx, raw) + 2*raw as sx
    from px window cx as (partition by frame, y order by x)) window cy as (partition by frame, x order by y)"""


@query("sobel_gradient", f"select frame, y, x, gx, gy, round(sqrt(gx*gx+gy*gy),6) as magnitude from ({SOBEL}) join px using (frame, y, x) where ocean")
def sobel_gradient(spark, sf):
    d = raster.sobel(dense(spark, sf), "raw", K).filter("ocean")
    return d.select(*PX, "gx", "gy", F.round("magnitude", 6).alias("magnitude"))


_GW = raster.gaussian_weights(1.0)


@query(
    "gaussian_smooth",
    f"""select p.frame, p.y, p.x, round(sum(q.raw * ({_GW}::double[])[(q.yy-p.y+5)::int] * ({_GW}::double[])[(q.xx-p.x+5)::int]),5) as raw from px p join {_mirror_sql(4)} q
      on q.frame = p.frame and abs(q.yy - p.y) <= 4 and abs(q.xx - p.x) <= 4 group by p.frame, p.y, p.x""",
)
def gaussian_smooth(spark, sf):
    return rounded(raster.gaussian(dense(spark, sf), "raw", K, 1.0, W, H), 5)


@query("downsample", "select frame, y//2 as y, x//2 as x, avg(r) as r, avg(g) as g, avg(b) as b from px group by frame, y//2, x//2")
def downsample(spark, sf):
    return raster.downsample(dense(spark, sf), ["r", "g", "b"], K, 2)


@query("upsample_nearest", "select p.frame, p.y, p.x, s.r from px p join (select frame, y//2 as y, x//2 as x, avg(r) as r from px group by frame, y//2, x//2) s on s.frame=p.frame and s.y = p.y//2 and s.x = p.x//2")
def upsample_nearest(spark, sf):
    return raster.upsample_nearest(raster.downsample(dense(spark, sf), ["r"], K, 2), K, 2, W, H)


def patch_channels():
    r, g, b = C("r"), C("g"), C("b")
    out = {n: c / 255 for n, c in (("r", r), ("g", g), ("b", b))}
    h = colour.hsv(r, g, b)
    out |= {"h": h["h"] / 360, "s": h["s"] / 255, "v": h["v"] / 255}
    lab = colour.lab(r, g, b)
    out |= {"l": lab["l"] / 100, "a": lab["a"] / 128, "lb": lab["lb"] / 128}
    out |= {
        "intensity": colour.intensity(r, g, b) / 255,
        "dominance": colour.blue_dominance(r, g, b, 1.0),
        "spread": colour.colour_range(r, g, b) / 255,
    }
    return out


_CH = {
    "r": "r/255e0", "g": "g/255e0", "b": "b/255e0", "h": "h/360", "s": "s/255", "v": "v/255", "l": "l/100", "a": "a/128", "lb": "lb/128",
    "intensity": "(r+g+b)/3e0/255", "dominance": "case when r>0 or g>0 then b/(greatest(r,g)+1e0) else 0 end", "spread": "(greatest(r,g,b)-least(r,g,b))/255e0",
}


@query(
    "patch_features",
    f"""select q.frame, p.py, p.px, {', '.join(f'round(avg({e}),5) as {n}_mean, round(stddev_pop({e}),5) as {n}_std, round(min({e}),5) as {n}_min, round(max({e}),5) as {n}_max' for n, e in _CH.items())}
      from {LABX} q, (values (2,2),(2,5),(5,2),(5,5)) p(py, px) where abs(q.y-p.py) <= 2 and abs(q.x-p.px) <= 2 group by q.frame, p.py, p.px""",
)
def patch_features(spark, sf):
    return rounded(raster.patch_features(dense(spark, sf), patch_channels(), K, 2, 2, 3, W, H), 5)


_UO = f"{WAVES} intersect select * from ({dilated(COLD, 1)}) except {dilated(LAND, 1)}"
_UL = f"{WAVES} intersect select * from ({dilated(LAND, 1)}) except {dilated(COLD, 1)}"


@query("fill_undefined", f"select *, 'ocean' as surface from ({COLD} union ({_UO})) union all select *, 'land' as surface from ({LAND} union ({_UL}))")
def fill_undefined(spark, sf):
    """Wave pixels handed to the only class they touch."""
    o, l_ = raster.fill_undefined(cold(spark, sf), mask(spark, sf, "land"), mask(spark, sf, "waves"), K, 1, W, H)
    return o.withColumn("surface", F.lit("ocean")).union(l_.withColumn("surface", F.lit("land")))


@query(
    "local_adaptive_threshold",
    """select frame, y, x from (select p.frame, p.y, p.x, any_value(p.raw) as raw, avg(q.raw) as m, stddev_pop(q.raw-2950e0) as s from px p join px q
      on q.frame = p.frame and abs(q.y - p.y) <= 2 and abs(q.x - p.x) <= 2 group by p.frame, p.y, p.x) where raw < m - 1.5*s""",
)
def local_adaptive(spark, sf):
    return raster.local_adaptive(dense(spark, sf), "raw", K, 2, W, H, 1.5, 2950.0).select(*PX)


# ---- statistics --------------------------------------------------------------------------------


@query(
    "class_stats",
    """select media, frame, surface, count(*) as pixels, round(avg(raw)/10-273.15,6) as mean, round(stddev_pop(raw)/10,5) as std, round(min(raw)/10-273.15,6) as min,
      round(max(raw)/10-273.15,6) as max, round(quantile_cont(raw,0.5)/10-273.15,6) as median, round(count(*)/64e0*100,6) as coverage_pct
      from (select *, case when ocean then 'ocean' when land then 'land' else 'waves' end as surface from px) group by media, frame, surface""",
)
def class_stats(spark, sf):
    d = A.class_stats(pixels(spark, sf), MF)
    return d.select(*MF, "surface", "pixels", *[F.round(c, 5 if c == "std" else 6).alias(c) for c in ("mean", "std", "min", "max", "median", "coverage_pct")])


@query(
    "frame_trends",
    """select media, count(*) as frames, round(avg(o),6) as ocean_mean, round(avg(l),6) as land_mean, round(avg(l-o),6) as difference, round(avg(c),6) as ocean_pct,
      round(max(o)-min(o),6) as ocean_range from (select media, frame, avg(raw) filter (ocean)/10-273.15 as o, avg(raw) filter (land)/10-273.15 as l,
      avg(ocean::int)*100 as c from px group by media, frame) group by media""",
)
def frame_trends(spark, sf):
    t = A.frame_trends(pixels(spark, sf), MF)
    d = t.groupBy("media").agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.avg(c).alias(c) for c in ("ocean_mean", "land_mean", "difference", "ocean_pct")],
        (F.max("ocean_mean") - F.min("ocean_mean")).alias("ocean_range"),
    )
    return rounded(d)


LUM = "(0.2989e0*r+0.5870e0*g+0.1140e0*b)"


def with_lum(spark, sf):
    return pixels(spark, sf).withColumn("lum", colour.luminance(C("r"), C("g"), C("b")))


@query("pearson_corr", f"select frame, round(corr({LUM}, raw),6) as direct, round(corr({LUM}, -raw),6) as inverted from px group by frame")
def pearson(spark, sf):
    d = with_lum(spark, sf).groupBy("frame").agg(F.corr("lum", "raw").alias("direct"), F.corr("lum", -C("raw")).alias("inverted"))
    return rounded(d)


@query("poly_fit", f"select media, round(regr_slope({LUM}, raw),6) as slope, round(regr_intercept({LUM}, raw),3) as intercept from px group by media")
def poly_fit(spark, sf):
    d = with_lum(spark, sf).groupBy("media").agg(
        F.round(F.regr_slope("lum", "raw"), 6).alias("slope"), F.round(F.regr_intercept("lum", "raw"), 3).alias("intercept")
    )
    return d


_POWERS = ", ".join(f"sum(pow(t, {i}))::double as s{i}" for i in range(5)) + ", " + ", ".join(f"sum(pow(t, {i}) * w) as y{i}" for i in range(3))
_DET = "({0}*({4}*{8}-{5}*{7}) - {1}*({3}*{8}-{5}*{6}) + {2}*({3}*{7}-{4}*{6}))".format
_Q = (  # determinants of the normal equations about raw = 2950
    _DET("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"),
    _DET("y0", "s1", "s2", "y1", "s2", "s3", "y2", "s3", "s4"),
    _DET("s0", "y0", "s2", "s1", "y1", "s3", "s2", "y2", "s4"),
    _DET("s0", "s1", "y0", "s1", "s2", "y1", "s2", "s3", "y2"),
)


@query(
    "poly_fit_quadratic",
    f"""select media, round(q,6) as quadratic, round(c - 20*b + 400*q,3) as at_2930, round(c,3) as at_2950, round(c + 20*b + 400*q,3) as at_2970 from (
      select media, {_Q[1]}/d as c, {_Q[2]}/d as b, {_Q[3]}/d as q from (select *, {_Q[0]} as d from (
        select media, {_POWERS} from (select media, raw - 2950 as t, {LUM} as w from px) group by media)))""",
)
def poly_fit2(spark, sf):
    """The curve by its bend and three of its points."""
    d = A.poly_fit2(with_lum(spark, sf), ["media"], "raw", "lum")
    at = lambda x: F.round(C("quadratic") * x * x + C("linear") * x + C("constant"), 3).alias(f"at_{x}")
    return d.select("media", F.round("quadratic", 6).alias("quadratic"), at(2930), at(2950), at(2970))


_EXT = f"""select p.*, lum < lo as dark, lum > hi as light from (select *, {LUM} as lum from px) p
  join (select frame, quantile_cont({LUM}, 0.1) as lo, quantile_cont({LUM}, 0.9) as hi, quantile_cont({LUM}, 0.2) as p20 from px group by frame) using (frame)"""


@query(
    "dark_light_contrast",
    f"""select frame, round(d,6) as dark_mean, round(l,6) as light_mean, round(l-d,6) as difference, case when l-d > 0 then 'Standard' else 'Inverted' end as mapping
      from (select frame, avg(raw) filter (dark) as d, avg(raw) filter (light) as l from ({_EXT}) group by frame)""",
)
def dark_light(spark, sf):
    p = dense(spark, sf).withColumn("lum", colour.luminance(C("r"), C("g"), C("b")))
    q = p.groupBy("frame").agg(F.percentile("lum", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    d = p.join(q, "frame").groupBy("frame").agg(
        F.avg(F.when(C("lum") < C("q")[0], C("raw"))).alias("dark_mean"), F.avg(F.when(C("lum") > C("q")[1], C("raw"))).alias("light_mean")
    )
    diff = C("light_mean") - C("dark_mean")
    return rounded(d.withColumn("difference", diff).withColumn("mapping", F.when(diff > 0, "Standard").otherwise("Inverted")))


@query(
    "false_positive_share",
    f"""select frame, count(*) as dark_pixels, round(avg((not ocean)::int),6) as share from (select p.*, {LUM} as lum from px p)
      join (select frame, quantile_cont({LUM}, 0.2) as p20 from px group by frame) using (frame) where lum < p20 group by frame""",
)
def false_positive_share(spark, sf):
    p = dense(spark, sf).withColumn("lum", colour.luminance(C("r"), C("g"), C("b")))
    q = p.groupBy("frame").agg(F.percentile("lum", F.lit(0.2)).alias("q"))
    d = p.join(q, "frame").filter(C("lum") < C("q"))
    return rounded(d.groupBy("frame").agg(F.count(F.lit(1)).alias("dark_pixels"), F.avg((~C("ocean")).cast("int")).alias("share")))


@query(
    "raster_histogram",
    """select frame, bin, count(*) as n from (select frame, case when lo = hi then 15 else least(cast(floor((raw-lo)*30/(hi-lo)::double) as int), 29) end as bin
      from px join (select frame, min(raw) as lo, max(raw) as hi from px group by frame) using (frame)) group by frame, bin""",
)
def raster_histogram(spark, sf):
    return A.raster_histogram(pixels(spark, sf), K, "raw", 30)


@query(
    "frame_difference",
    """select a.media, a.frame, count(*) as n, round(avg(b.raw-a.raw),6) as mean_diff, max(abs(b.raw-a.raw)) as max_abs from
      (select *, dense_rank() over (partition by media order by frame) as i from px) a
      join (select *, dense_rank() over (partition by media order by frame) as i from px) b on a.media=b.media and b.i=a.i+1 and a.y=b.y and a.x=b.x group by all""",
)
def frame_difference(spark, sf):
    """Each frame against the next one of its directory."""
    from ..operators.ordered import neighbours, with_index

    p = pixels(spark, sf).select("media", "frame", "y", "x", "raw")
    nxt = neighbours(
        with_index(p.select("media", "frame").distinct(), ["media"], "frame"), ["media"], {"next": lambda w: F.lead("frame").over(w)}, before=0, after=1
    ).filter("next is not null").select("media", "frame", "next")
    b = p.select("media", C("frame").alias("next"), "y", "x", C("raw").alias("raw2"))
    j = p.join(nxt, ["media", "frame"]).join(b, ["media", "next", "y", "x"])
    d = C("raw2") - C("raw")
    return j.groupBy("media", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.max(F.abs(d)).alias("max_abs")
    )


RECTS = [("top_left", 0, 3, 0, 3), ("ocean", 3, 6, 1, 4), ("land", 1, 4, 5, 8), ("centre", 2, 6, 2, 6)]


@query(
    "named_region_stats",
    f"""select frame, name, min(raw) as min, max(raw) as max, round(avg(raw),6) as mean, round(stddev_pop(raw-2950e0),5) as std, stddev_pop(raw-2950e0) < 5 as uniform
      from px join (values {', '.join(str(r) for r in RECTS)}) r(name, y0, y1, x0, x1) on y >= y0 and y < y1 and x >= x0 and x < x1 group by frame, name""",
)
def named_region_stats(spark, sf):
    """The rectangles are literals: each pixel lists the few it lies in."""
    inside = [F.when((C("y") >= a) & (C("y") < b) & (C("x") >= c) & (C("x") < d), n) for n, a, b, c, d in RECTS]
    p = pixels(spark, sf).select("frame", "raw", F.explode(F.array_compact(F.array(*inside))).alias("name"))
    s = F.stddev_pop(C("raw") - 2950)
    return p.groupBy("frame", "name").agg(
        F.min("raw").alias("min"), F.max("raw").alias("max"), F.round(F.avg("raw"), 6).alias("mean"), F.round(s, 5).alias("std"), (s < 5).alias("uniform")
    )


@query(
    "rendering_audit",
    f"""select frame, round(c,6) as correlation, round(rr/lr,6) as range_ratio, round(flat,5) as hist_std,
      case when c < 0.7 and -c > 0.7 then 'inverted' when c > 0.7 then 'standard' else 'non_linear' end as mapping, flat < 1000 as equalised, rr/lr > 100 as compressed
      from (select frame, corr({LUM}, raw) as c, (max(raw)-min(raw))::double as rr, max({LUM})-min({LUM}) as lr from px group by frame)
      join (select frame, sqrt(sum(n*n)/256e0 - pow(sum(n)/256e0, 2)) as flat from (select frame, bin, count(*) as n from (
        select frame, case when hi = lo then 128 else least(cast(floor(({LUM}-lo)*256/(hi-lo)) as int), 255) end as bin from px
        join (select frame, min({LUM}) as lo, max({LUM}) as hi from px group by frame) using (frame)) group by all) group by frame) using (frame)""",
)
def rendering_audit(spark, sf):
    p = with_lum(spark, sf)
    d = p.groupBy("frame").agg(
        F.corr("lum", "raw").alias("c"), (F.max("raw") - F.min("raw")).cast("double").alias("rr"), (F.max("lum") - F.min("lum")).alias("lr")
    )
    h = A.raster_histogram(p, K, "lum", 256).groupBy("frame").agg(
        F.sqrt(F.sum(C("n") * C("n")) / 256.0 - F.pow(F.sum("n") / 256.0, F.lit(2.0))).alias("flat")
    )
    j, c = d.join(h, "frame"), C("c")
    return j.select(
        "frame",
        F.round(c, 6).alias("correlation"),
        F.round(C("rr") / C("lr"), 6).alias("range_ratio"),
        F.round("flat", 5).alias("hist_std"),
        F.when((c < 0.7) & (-c > 0.7), "inverted").when(c > 0.7, "standard").otherwise("non_linear").alias("mapping"),
        (C("flat") < 1000).alias("equalised"),
        (C("rr") / C("lr") > 100).alias("compressed"),
    )


@query(
    "rank_quantile_samples",
    """select frame, idx, raw, y, x from (select *, row_number() over (partition by frame order by raw, y, x) - 1 as idx from px) where idx in (0, 15, 31, 47, 63)""",
)
def rank_quantile_samples(spark, sf):
    """Pixels at five evenly spaced ranks of a frame (bounded by its size)."""
    from pyspark.sql import Window

    d = dense(spark, sf).withColumn("idx", F.row_number().over(Window.partitionBy("frame").orderBy("raw", "y", "x")) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("frame"))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (n - 1) / 4.0))
    return d.withColumn("ranks", ranks).filter(F.array_contains("ranks", C("idx").cast("bigint"))).select("frame", "idx", "raw", "y", "x")


@query(
    "hot_cold_spots",
    """select frame, max(raw) as hot_raw, min(raw) as cold_raw, min(y*8+x) filter (raw = hi) as hot_pos, min(y*8+x) filter (raw = lo) as cold_pos
      from (select *, max(raw) over w as hi, min(raw) over w as lo from px window w as (partition by frame)) group by frame""",
)
def hot_cold_spots(spark, sf):
    pos = C("y") * 8 + C("x")
    return pixels(spark, sf).groupBy("frame").agg(
        F.max("raw").alias("hot_raw"),
        F.min("raw").alias("cold_raw"),
        F.max_by(pos, F.struct("raw", -pos)).alias("hot_pos"),
        F.min_by(pos, F.struct("raw", pos)).alias("cold_pos"),
    )


_TILES = """select t.frame, ty, tx, round(stddev_pop(raw-2950e0),5) as std, avg(raw) as mean, min(raw) as lo, max(raw) as hi from px t,
  (select unnest(range(0, 4, 2)) as ty), (select unnest(range(0, 4, 2)) as tx) where t.y between ty and ty+3 and t.x between tx and tx+3 group by t.frame, ty, tx"""
_TOP = f"select *, row_number() over (partition by frame order by std desc, ty, tx) as rank from ({_TILES})"


def tiles(px, keys, size, stride, width, height):
    """Statistics of sliding square tiles; a pixel goes to the few tiles that hold it."""

    def starts(axis, extent):
        lo = F.greatest(F.ceil((C(axis) - size + 1) / stride), F.lit(0)).cast("int")
        hi = F.least(F.floor(C(axis) / stride), F.lit((extent - size - 1) // stride)).cast("int")
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: i * stride))

    d = px.select(*keys, F.explode(starts("y", height)).alias("ty"), "x", "raw").select(*keys, "ty", F.explode(starts("x", width)).alias("tx"), "raw")
    return d.groupBy(*keys, "ty", "tx").agg(
        F.round(F.stddev_pop(C("raw") - 2950), 5).alias("std"), F.avg("raw").alias("mean"), F.min("raw").alias("lo"), F.max("raw").alias("hi")
    )


def ranked_tiles(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("frame").orderBy(F.desc("std"), "ty", "tx")
    return tiles(dense(spark, sf), K, 4, 2, W, H).withColumn("rank", F.row_number().over(w))


@query("top_variable_tiles", f"select frame, rank, ty, tx, std, round(mean,6) as mean, lo, hi from ({_TOP}) where rank <= 10")
def top_variable_tiles(spark, sf):
    return ranked_tiles(spark, sf).filter(C("rank") <= 10).withColumn("mean", F.round("mean", 6))


@query(
    "disjoint_top_pairs",
    f"""select a.frame, a.rank, min(b.rank) as partner from ({_TOP}) a join ({_TOP}) b on a.frame = b.frame and b.rank > a.rank
      and (abs(a.tx-b.tx) > 1 or abs(a.ty-b.ty) > 1) where a.rank <= 5 group by a.frame, a.rank""",
)
def disjoint_top_pairs(spark, sf):
    """Partner of each of the top five: the next-ranked tile that lies elsewhere.  Lists hold one frame's tiles."""
    t = ranked_tiles(spark, sf)
    g = t.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("rank", "ty", "tx"))).alias("all"))
    d = g.select("frame", "all", F.explode(F.slice("all", 1, 5)).alias("a"))
    far = lambda b: (b["rank"] > C("a.rank")) & ((F.abs(b["tx"] - C("a.tx")) > 1) | (F.abs(b["ty"] - C("a.ty")) > 1))
    d = d.withColumn("b", F.filter("all", far)).filter(F.size("b") > 0)
    return d.select("frame", C("a.rank").alias("rank"), C("b")[0]["rank"].alias("partner"))
