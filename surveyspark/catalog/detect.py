"""Detection compositions, glint, thresholds, segmentation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import colour, geo
from ..operators import baseline as B
from ..operators import glint as GL
from ..operators import regions
from ..operators.ordered import neighbours, with_index
from ..plans import detect as D
from ..plans import segment as S
from ..session import cut_lineage
from ..sources.tables import SMALL, H, W, captures, directories, named_frames, pixels
from .base import ORACLE, query, with_views
from .baselines import _CONT, _MODAL, _TRIM, KEYS, hav_sql, hist, lagged, rounded
from .rasters import SOBEL, _box_sql, _mirror_sql, dense
from .scalars import LABX, PXC
from .views import VIEWS, components, dilated, eroded, eroded_open_border, filled, large, masks_of, plumes, smoothed

C = F.col
THRESHOLDS = [0.5, 1.0, 1.5, 2.0]
_ACC = "min_shore < 1 and area >= 2"
_ACCM = _ACC + " and area <= 20"
_EDGE = "(t_top or t_bottom or t_left or t_right)"
_ACCE = f"case when {_EDGE} then min_shore < 2 and area >= 1 else {_ACCM} end"
VIEWS["found"] = f"select * from plume where {_ACCM}"
_OUT = "frame, region, area, round(cy,6) as cy, round(cx,6) as cx, round(mean_temp,6) as mean_temp, round(min_temp,6) as min_temp, round(max_temp,6) as max_temp, round(anomaly,6) as anomaly, round(min_shore,6) as min_shore, round(eccentricity,5) as eccentricity"


def by_directory(spark, sf):
    return pixels(spark, sf, colocate=KEYS)


def shown(d, *extra):
    six = ("cy", "cx", "mean_temp", "min_temp", "max_temp", "anomaly", "min_shore")
    return d.select(*extra, "frame", "region", "area", *[F.round(c, 6).alias(c) for c in six], F.round("eccentricity", 5).alias("eccentricity"))


def found(spark, sf):
    return D.detect(by_directory(spark, sf), SMALL)


@query("detect_plumes", f"select {_OUT} from found")
def detect_plumes(spark, sf):
    return shown(found(spark, sf))


@query("detect_plumes_moving", f"select {_OUT} from plume_mv where {_ACCM}")
def detect_plumes_moving(spark, sf):
    return shown(D.detect_moving(by_directory(spark, sf), SMALL))


@query("detect_plumes_edge", f"select {_OUT}, {_EDGE} as is_edge from plume_mv where {_ACCE}")
def detect_plumes_edge(spark, sf):
    return shown(D.detect_edge(by_directory(spark, sf), SMALL), "is_edge")


@query("multi_threshold", f"select threshold, {_OUT} from plume_t where {_ACCM}")
def multi_threshold(spark, sf):
    """All thresholds from one read of the pixels."""
    return shown(D.detect_thresholds(by_directory(spark, sf), SMALL, THRESHOLDS), "threshold")


@query("plume_accept", f"select frame, region, area from plume where {_ACCM}")
def plume_accept(spark, sf):
    return D.accept(D.regions_of(by_directory(spark, sf), replace(SMALL, window=0)), SMALL).select("frame", "region", "area")


@query("plume_accept_edge", f"select frame, region, area from plume where {_ACCE}")
def plume_accept_edge(spark, sf):
    return D.accept_edge(D.regions_of(by_directory(spark, sf), replace(SMALL, window=0)), SMALL).select("frame", "region", "area")


@query("plume_accept_mean_distance", f"select frame, region, area from plume where {_ACC} and mean_shore < 0.5")
def plume_accept_mean(spark, sf):
    cfg = replace(SMALL, window=0, max_area=None)
    return D.accept(D.regions_of(by_directory(spark, sf), cfg), cfg).filter("mean_shore < 0.5").select("frame", "region", "area")


@query("no_ocean_filter", "select frame, round(avg(ocean::int),6) as ocean_fraction, avg(ocean::int) < 0.7 as skipped from px group by frame")
def no_ocean(spark, sf):
    d = D.ocean_share(pixels(spark, sf))
    return d.select("frame", F.round("ocean_fraction", 6).alias("ocean_fraction"), (C("ocean_fraction") < 0.7).alias("skipped"))


@query("valid_temp", "select frame, count(*) as n from px where ocean group by frame")
def valid_temp(spark, sf):
    """Masked pixels become NULL and drop out; NaN never passes."""
    t = F.when(C("ocean"), (C("raw") / 10 - 273.15)).otherwise(F.lit(float("nan")))
    d = pixels(spark, sf).withColumn("t", F.nullif(t, F.lit(float("nan"))))
    return d.filter(C("t").isNotNull() & ~F.isnan("t")).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("cold_predicate", "select frame, y, x from cold")
def cold_predicate(spark, sf):
    p = pixels(spark, sf)
    return D.cold_pixels(p, D.baselines(p, replace(SMALL, window=0)), [0.5]).select("frame", "y", "x")


@query(
    "detect_cold",
    """select frame, n_adaptive, n_mean from (select p.frame, count(*) filter (p.raw < greatest(m.m - 5, m.q25 - 1.5*(m.q75-m.q25))) as n_adaptive,
      count(*) filter (p.raw < a.a - 5) as n_mean from px p join med m using (frame) join (select frame, avg(raw) as a from px where ocean group by frame) a using (frame)
      where p.ocean group by p.frame)""",
)
def detect_cold(spark, sf):
    """Robust and mean-based cold counts, on histograms."""
    h = hist(spark, sf)
    q = h.groupBy(*KEYS).agg(
        F.percentile("raw", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), C("n")).alias("q"), (F.sum(C("raw") * C("n")) / F.sum("n")).alias("a")
    )
    cut = F.greatest(C("q")[1] - 5, C("q")[0] - (C("q")[2] - C("q")[0]) * 1.5)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, C("n"))), F.lit(0))
    return h.join(q, KEYS).groupBy("frame").agg(n(C("raw") < cut).alias("n_adaptive"), n(C("raw") < C("a") - 5).alias("n_mean"))


@query(
    "include_waves",
    """select frame, count(*) as n_cold from px p join (select frame, quantile_cont(raw,0.5) as m from px where ocean or waves group by frame) using (frame)
      where (ocean or waves) and raw < m - 5 group by frame""",
)
def include_waves(spark, sf):
    cfg = replace(SMALL, window=0, include_waves=True)
    p = D.with_waves(pixels(spark, sf), cfg)
    return D.cold_pixels(p, D.baselines(p, cfg), [0.5]).groupBy("frame").agg(F.count(F.lit(1)).alias("n_cold"))


@query("frame_characteristics", """select frame, count(*) as n_plumes, sum(area) as area_px, round(sum(area)*0.01e0,6) as area_m2, round(sum(mean_temp*area)/sum(area),6) as mean_temp,
  round(min(min_temp),6) as min_temp, round(max(max_temp),6) as max_temp, round(sum(anomaly*area)/sum(area),6) as anomaly from found group by frame""")
def frame_characteristics(spark, sf):
    return rounded(D.frame_characteristics(found(spark, sf)).drop("media"))


@query("frames_x_thresholds", "select p.frame, threshold, count(*) as n_cold from px p join med using (frame), thr where p.ocean and p.raw < m - 10*threshold group by all")
def frames_x_thresholds(spark, sf):
    h = hist(spark, sf)
    base = B.percentile_baseline(h, KEYS, 0.5)
    level = D.raw_level(C("baseline"))
    passed = F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: C("raw") < level - t * 10)
    d = h.join(base, KEYS).withColumn("threshold", F.explode(passed))
    return d.groupBy("frame", "threshold").agg(F.sum("n").alias("n_cold"))


_PC = "select media, frame, '{n}' as method, quantile_cont(raw,{p})/10-273.15 as baseline from px where ocean group by media, frame"
VIEWS["base_all"] = " union all ".join(
    [
        _PC.format(n="median", p=0.5),
        _PC.format(n="upper_quartile", p=0.75),
        _PC.format(n="percentile_90", p=0.9),
        f"select media, frame, 'trimmed_mean' as method, baseline from ({_TRIM})",
        f"select media, frame, 'modal_peak' as method, baseline from ({_MODAL})",
    ]
)
METHODS = ["median", "upper_quartile", "percentile_90", "trimmed_mean", "modal_peak"]


def all_baselines(h):
    """Every baseline of every frame, long form, from one histogram."""
    wide = None
    for m in METHODS:
        b = B.BASELINES[m](h, KEYS).withColumnRenamed("baseline", m)
        wide = b if wide is None else wide.join(b, KEYS)
    return wide.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(m).alias("method"), C(m).alias("baseline")) for m in METHODS])))


@query("frames_x_baselines", "select frame, method, round(baseline,6) as baseline from base_all")
def frames_x_baselines(spark, sf):
    return rounded(all_baselines(hist(spark, sf)).drop("media"))


_BC = ", ".join(
    f"{k} AS ({v})"
    for k, v in {
        "bc_c": "select method, frame, y, x from px p join base_all b using (frame) where p.ocean and p.raw < round((baseline+273.15)*10,6) - 10",
        **components("bc", "select method, frame, y, x from bc_c", 8, "method, frame"),
    }.items()
)


@query(
    "baseline_comparison",
    f"WITH {_BC} select method, frame, count(distinct region) as n_regions, count(*) as area_px from bc group by method, frame",
)
def baseline_comparison(spark, sf):
    """Regions one degree below each baseline, all methods labelled together."""
    p = by_directory(spark, sf)
    b = all_baselines(B.temp_hist(p, KEYS))
    c = p.filter("ocean").join(b, KEYS).filter(C("raw") < D.raw_level(C("baseline")) - 10)
    lab = regions.label_regions(c, ["method", *KEYS], W)
    return lab.groupBy("method", "frame").agg(F.countDistinct("region").alias("n_regions"), F.count(F.lit(1)).alias("area_px"))


# ---- glint -------------------------------------------------------------------------------------

_RGBG = f"""select frame, avg((g>0.8)::int) as bf, avg((g>0.95)::int) as sf, avg(g) as bm, stddev_pop(g) as bs, max(g) as bx from (
  select frame, (0.2125e0*r+0.7154e0*g+0.0721e0*b)/255 as g from px where ocean) group by frame"""
_RGBF = "(bf > 0.2 or sf > 0.1 or bm > 0.7)"


@query(
    "glint_rgb",
    f"""select frame, round(bf,6) as bright_fraction, round(sf,6) as saturated_fraction, round(bm,6) as brightness_mean, round(bs,6) as brightness_std, round(bx,6) as brightness_max,
      {_RGBF} as rgb_glint from ({_RGBG})""",
)
def glint_rgb(spark, sf):
    return rounded(GL.rgb_evidence(GL.summary(pixels(spark, sf), ["frame"]), ["frame"]))


_TH = """select frame, coalesce(px,0)/n as pf, cf, case when coalesce(px,0)/n > 0.2 then 'plume_area' when ecc < 0.5 and big > 5 then 'round_plume' when cf > 0.2 then 'cold_area' end as why
  from (select p.frame, count(*)::double as n, avg((raw < m - 3*mad)::int) as cf from px p join med using (frame)
    join (select p.frame, quantile_cont(abs(raw-m),0.5) as mad from px p join med using (frame) where ocean group by p.frame) using (frame) where ocean group by p.frame)
  left join (select frame, sum(area) as px, arg_max(eccentricity, area*1000-region) as ecc, max(area) as big from found group by frame) using (frame)"""


@query("glint_infrared", f"select frame, round(pf,6) as plume_fraction, round(cf,6) as cold_fraction, why as infrared_reason, why is not null as infrared_glint from ({_TH})")
def glint_infrared(spark, sf):
    p = by_directory(spark, sf)
    d = GL.infrared_evidence(B.temp_hist(p, KEYS), D.detect(p, SMALL), KEYS, round_area=5)
    return rounded(d.drop("media"))


_TURN = """select media, frame, abs(case when t > 180 then t-360 else t end) > 15 as rapid from (select media, frame, ((hd - lag(hd) over (partition by media order by frame)) % 360 + 360) % 360 as t
  from (select f.media, f.frame, c.heading as hd from ocean_frames f join captures c using (frame)))"""
_CONF = f"""select frame, (case when {_RGBF} then 4 else 0 end + case when why is not null then 3 else 0 end
  + case when coalesce(temp_jump > 2.0 or deviation > 3.0, false) then 2 else 0 end + case when rapid then 1 else 0 end) as tenths
  from ({_RGBG}) join ({_TH}) using (frame) join ({_CONT}) using (frame) left join ({_TURN}) using (frame)"""


def verdict(spark, sf):
    """Votes of all frames: one read of the pixels for histogram and brightness, one for the plumes."""
    p = by_directory(spark, sf)
    sums = cut_lineage(GL.summary(p, KEYS))
    h = sums.select(*KEYS, "raw", "n")
    med = B.percentile_baseline(h, KEYS, 0.5, out="median")
    cont = B.continuity(med, ["media"])
    # Headings come from the capture log; the turn is taken between successive frames of a directory.
    hd = cont.select(*KEYS, "idx").join(directories(captures(spark, sf)).select(*KEYS, "heading"), KEYS)
    turns = neighbours(hd, ["media"], {"ph": lambda w: F.lag("heading").over(w)})
    turns = turns.withColumn("rapid", F.abs(geo.turn_deg(C("heading"), C("ph"))) > 15)
    plumes = D.detect(p, SMALL, base=B.BASELINES[SMALL.baseline](h, KEYS))
    th = GL.infrared_evidence(h, plumes, KEYS, round_area=5)
    return GL.confidence(GL.rgb_evidence(sums, KEYS), th, cont, turns, KEYS)


@query("glint_confidence", f"select frame, tenths, tenths >= 5 as has_glint, tenths > 7 as veto from ({_CONF})")
def glint_confidence(spark, sf):
    return verdict(spark, sf).select("frame", "tenths", "has_glint", "veto")


@query("glint_filter", f"select frame from px where frame not in (select frame from ({_CONF}) where tenths >= 5) group by frame")
def glint_filter(spark, sf):
    flagged = verdict(spark, sf).filter("has_glint").select(*KEYS)
    return pixels(spark, sf).select(*KEYS).distinct().join(flagged, KEYS, "left_anti").select("frame")


@query("detect_with_glint", f"select {_OUT} from found where frame not in (select frame from ({_CONF}) where tenths > 7)")
def detect_with_glint(spark, sf):
    return shown(GL.veto(found(spark, sf), verdict(spark, sf), KEYS))


# ---- thresholds --------------------------------------------------------------------------------

_TS = f"select threshold, count(*) as detections, sum(area) as total_area, count(distinct frame) as frames from plume_t where {_ACCM} group by threshold"


def threshold_stats(spark, sf):
    d = D.detect_thresholds(by_directory(spark, sf), SMALL, THRESHOLDS)
    return d.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("detections"), F.sum("area").alias("total_area"), F.countDistinct("frame").alias("frames")
    )


@query("threshold_summary", f"select t.*, (select detections from ({_TS}) order by threshold limit 1) as lowest_detections from ({_TS}) t")
def threshold_summary(spark, sf):
    s = threshold_stats(spark, sf)
    low = s.agg(F.min_by("detections", "threshold")).scalar()
    return s.withColumn("lowest_detections", low)


@query(
    "nesting_check",
    f"""select threshold, detections > pd as more_plumes, total_area > pa as more_area from (select *, lag(detections) over (order by threshold) as pd,
      lag(total_area) over (order by threshold) as pa from ({_TS})) where pd is not null""",
)
def nesting_check(spark, sf):
    """One row per threshold step; the ordered window covers the handful of thresholds only."""
    from pyspark.sql import Window

    w = Window.orderBy("threshold")
    d = threshold_stats(spark, sf).withColumn("pd", F.lag("detections").over(w)).withColumn("pa", F.lag("total_area").over(w))
    return d.filter("pd is not null").select("threshold", (C("detections") > C("pd")).alias("more_plumes"), (C("total_area") > C("pa")).alias("more_area"))


@query(
    "edge_continuity",
    f"select f.media, count(*) as total, sum({_EDGE}::int)::bigint as edge_plumes, round(avg({_EDGE}::int)*100,6) as edge_pct from plume p join ocean_frames f using (frame) where {_ACCE} group by f.media",
)
def edge_continuity(spark, sf):
    d = D.accept_edge(D.regions_of(by_directory(spark, sf), replace(SMALL, window=0)), SMALL)
    e = C("is_edge").cast("int")
    return d.groupBy("media").agg(F.count(F.lit(1)).alias("total"), F.sum(e).alias("edge_plumes"), F.round(F.avg(e) * 100, 6).alias("edge_pct"))


_SIDES = [("top", "bottom"), ("bottom", "top"), ("left", "right"), ("right", "left")]
_ONE = " union all ".join(f"select frame, region, anomaly, '{a}' as side, '{b}' as opposite from found where t_{a}" for a, b in _SIDES)
VIEWS["sided"] = _ONE


@query(
    "plume_continuity_join",
    """select a.frame, a.region, a.side, count(*) as candidates, round(min(abs(a.anomaly-b.anomaly)),6) as best_difference
      from sided a join (select frame, lead(frame) over (partition by media order by frame) as nxt from ocean_frames) o on o.frame = a.frame
      join sided b on b.frame = o.nxt and b.side = a.opposite group by all""",
)
def plume_continuity(spark, sf):
    """Plumes cut by one side against those of the next frame cut by the opposite side."""
    p = by_directory(spark, sf)
    f = D.detect(p, SMALL)
    sides = F.array_compact(F.array(*[F.when(C(f"touch_{a}"), F.struct(F.lit(a).alias("side"), F.lit(b).alias("opposite"))) for a, b in _SIDES]))
    s = f.select(*KEYS, "region", "anomaly", F.inline(sides))
    order = with_index(p.filter("ocean").select(*KEYS).distinct(), ["media"], "frame")
    nxt = neighbours(order, ["media"], {"nxt": lambda w: F.lead("frame").over(w)}, before=0, after=1).select(*KEYS, "nxt").filter("nxt is not null")
    b = s.select("media", C("frame").alias("nxt"), C("side").alias("opposite"), C("anomaly").alias("other"))
    j = s.join(nxt, KEYS).join(b, ["media", "nxt", "opposite"])
    return j.groupBy("frame", "region", "side").agg(
        F.count(F.lit(1)).alias("candidates"), F.round(F.min(F.abs(C("anomaly") - C("other"))), 6).alias("best_difference")
    )


@query(
    "georeference_plumes",
    """select frame, region, area, round(lat + (e*sin(radians(-heading)) + n*cos(radians(-heading)))/111320,8) as plat,
      round(lon + (e*cos(radians(-heading)) - n*sin(radians(-heading)))/(111320*cos(radians(lat))),8) as plon, round(area*gsd*gsd,4) as area_m2, round(area*0.01e0,4) as area_px001_m2
      from (select f.*, c.lat, c.lon, c.heading, 2*c.altitude*tan(radians(22.5))/8 as gsd, (cx-4)*2*c.altitude*tan(radians(22.5))/8 as e, -(cy-4)*2*c.altitude*tan(radians(22.5))/8 as n
        from found f join captures c using (frame))""",
)
def georeference_plumes(spark, sf):
    from ..plans.survey import georeference

    d = georeference(found(spark, sf), directories(captures(spark, sf)), SMALL)
    return d.select(
        "frame", "region", "area", F.round("plat", 8).alias("plat"), F.round("plon", 8).alias("plon"),
        F.round("area_m2", 4).alias("area_m2"), F.round("area_px001_m2", 4).alias("area_px001_m2"),
    )


# ---- segmentation ------------------------------------------------------------------------------

_DARKROCK = "(v < 82 and dom < 1.2)"
_OC1 = "((h between 180 and 250 and s >= 30 and v between 40 and 200) or (v < 82 and dom > 1.3 and b > 30))"
_SEG = f"select *, case when s < 25 and v > 150 then 'waves' when {_OC1} and not {_DARKROCK} then 'ocean' else 'land' end as surface from {PXC}"


@query("segment_rule_pixels", f"select frame, y, x, surface from ({_SEG})")
def segment_rule_pixels(spark, sf):
    return S.by_rules(pixels(spark, sf)).select("frame", "y", "x", "surface")


_CL = ", ".join(
    f"{k} AS ({v})"
    for k, v in {
        "sg": f"select frame, y, x from ({_SEG}) where surface = 'ocean'",
        **components("sg4", "select * from sg", 4),
        "sgk": "select frame, y, x from sg4 qualify count(*) over (partition by frame, region) >= 2",
        **components("sg8", "select * from sgk", 8),
        "sgb": """select frame, y, x from sg8 join (select frame, region from (select frame, region, count(*) as c, row_number() over (partition by frame order by count(*) desc, region) as rk
            from sg8 group by frame, region) where rk = 1 and c > 0.05*64) using (frame, region)""",
        **components("sgh", "select p.frame, p.y, p.x from px p where p.frame in (select frame from sgb) except select * from sgb", 4),
    }.items()
)


@query("segment_rules_cleaned", f"WITH {_CL} select * from sgb union (select frame, y, x from sgh qualify count(*) over (partition by frame, region) < 3)")
def segment_rules_cleaned(spark, sf):
    return S.cleaned_ocean(S.by_rules(dense(spark, sf)), ["frame"], W, H, 2, 3)


_HO = "(h between 180 and 250 and s >= 20 and v between 20 and 200)"
_HL = "((h between 40 and 150 and s >= 15 and v >= 10) or v < 30)"
_HW = "(s <= 30 and v >= 180)"
_LO, _LL, _LW = "(lb < -5 and l > 20 and l < 80)", "((a < -5 and lb > -10) or l < 30)", "(l > 85 and abs(a) < 10 and abs(lb) < 10)"


def _res(o, l_, w):
    return f"case when {w} then 'waves' when {l_} then 'land' when {o} then 'ocean' end"


@query("segment_hsv_pixels", f"select frame, y, x, {_res(_HO, _HL, _HW)} as surface from {PXC}")
def segment_hsv_pixels(spark, sf):
    return S.by_hsv(pixels(spark, sf)).select("frame", "y", "x", "surface")


@query("segment_lab_pixels", f"select frame, y, x, {_res(_LO, _LL, _LW)} as surface from {LABX}")
def segment_lab_pixels(spark, sf):
    return S.by_lab(pixels(spark, sf)).select("frame", "y", "x", "surface")


_VO = f"(({_HO} and not {_HL} and not {_HW}) or ({_LO} and not {_LL} and not {_LW}) or (b > r*1.2 and b > g*1.1 and b > 50))"
_VL = f"(({_HL} and not {_HW}) or ({_LL} and not {_LW}) or (g > r*1.1 and g > b*1.1 and g > 30))"


@query("segment_vote_pixels", f"select frame, y, x, {_res(_VO, _VL, f'({_HW} and {_LW})')} as surface from {LABX}")
def segment_vote_pixels(spark, sf):
    return S.by_vote(pixels(spark, sf)).select("frame", "y", "x", "surface")


@query(
    "segment_hsv_aligned",
    f"select frame, y, x, coalesce({_res(_HO, _HL, _HW)}, case when b > g*1.1 then 'ocean' when g > b*1.1 then 'land' end) as surface from {PXC}",
)
def segment_hsv_aligned(spark, sf):
    return S.by_hsv_aligned(pixels(spark, sf)).select("frame", "y", "x", "surface")


@query(
    "segment_tunable",
    f"""select frame, y, x, case when rock then 'land' when wv then 'waves' when (h between 180 and 250 and s >= 20 and v between 30 and 200) or (dom > 1.2 and b > 20 and not wv) then 'ocean' else 'land' end as surface
      from (select *, s < 25 and v > 150 as wv, v < 82 and (greatest(r,g,b)-least(r,g,b) < 40 or dom < 1.2) as rock from {PXC})""",
)
def segment_tunable(spark, sf):
    return S.tunable(pixels(spark, sf)).select("frame", "y", "x", "surface")


_VN = """select frame, y, x, (variance - min(variance) over w)/(max(variance) over w - min(variance) over w) as vn from ({v}) window w as (partition by frame)"""
_V5 = _VN.format(v=_box_sql(2, "var_pop(q.raw-2950e0) as variance"))


def _land(method):
    return lambda spark, sf: S.by_temperature(dense(spark, sf), ["frame"], method, 22.0, W, H)


query("segment_infrared_pixels", "select frame, y, x, raw/10-273.15 > 22 as land_mask from px")(
    lambda spark, sf: _land("temperature")(spark, sf).select("frame", "y", "x", "land_mask")
)
query("segment_infrared_variance_pixels", f"select frame, y, x, vn >= 0.3 as land_mask from ({_V5})")(
    lambda spark, sf: _land("variance")(spark, sf).select("frame", "y", "x", "land_mask")
)
@query(
    "segment_infrared_adaptive",
    f"""select frame, y, x, round((1-(raw-min(raw) over w)/(max(raw) over w-min(raw) over w)::double)*0.4 + (1-(va-min(va) over w)/(max(va) over w-min(va) over w+1e-10))*0.3
      + (1-(gm-min(gm) over w)/(max(gm) over w-min(gm) over w+1e-10))*0.3, 5) as score
      from (select frame, y, x, raw, va, sqrt(gx*gx+gy*gy) as gm from px join ({SOBEL}) using (frame, y, x)
        join ({_box_sql(7, 'var_pop(q.raw-2950e0)/100 as va')}) using (frame, y, x)) window w as (partition by frame)""",
)
def segment_infrared_adaptive(spark, sf):
    return _land("adaptive")(spark, sf).select("frame", "y", "x", F.round("score", 5).alias("score"))


# Cleaned masks; the sizes shrink with the rasters.
_SURFACE = lambda kind: f"select frame, y, x from ({_SEG}) where surface = '{kind}'"
_RULES = {
    **large("ro", _SURFACE("ocean"), 3), **large("rl", _SURFACE("land"), 3), **large("rw", _SURFACE("waves"), 2), **components("r8", "select * from ro"),
    "rb": """select frame, y, x from r8 join (select frame, region from (select frame, region, count(*) as c, row_number() over (partition by frame order by count(*) desc, region) as rk
      from r8 group by frame, region) where rk = 1 and c > 0.2*64) using (frame, region)""",
    # Frames without any ocean keep their land without specks; in all others the rest is land.
    "rr": "select frame, y, x from px where frame in (select frame from ro) except (select * from rb union select * from rw) union select * from rl where frame not in (select frame from ro)",
    **filled("rof", "select * from rb", 3), **filled("rlf", "select * from rr", 3),
}


@query("segment_rules", masks_of(_RULES, "select * from rof", "select * from rlf", "select * from rw"))
def segment_rules(spark, sf):
    return S.rule_masks(dense(spark, sf), ["frame"], W, H, 3, 2, 3, 0.2)


def _ranked(o, l_, w):
    """Waves beat land, land beats ocean."""
    return f"select * from {o} except select * from {w} except select * from {l_}", f"select * from {l_} except select * from {w}", f"select * from {w}"


def _range_ctes(p, table, o, l_, w):
    return {f"{p}x": f"select * from {table}", **{k: v for m, c, n in ((f"{p}o", o, 3), (f"{p}l", l_, 3), (f"{p}w", w, 2)) for k, v in smoothed(m, f"select frame, y, x from {p}x where {c}", n).items()}}


_HSV = _range_ctes("hs", PXC, _HO, _HL, _HW)
_LAB = _range_ctes("la", LABX, _LO, _LL, _LW)


@query("segment_hsv", masks_of(_HSV, *_ranked("hso", "hsl", "hsw")))
def segment_hsv(spark, sf):
    return S.hsv_masks(dense(spark, sf), ["frame"], W, H, 3, 2)


@query("segment_lab", masks_of(_LAB, *_ranked("lao", "lal", "law")))
def segment_lab(spark, sf):
    return S.lab_masks(dense(spark, sf), ["frame"], W, H, 3, 2)


_HSR, _LAR = _ranked("hso", "hsl", "hsw"), _ranked("lao", "lal", "law")
_VOTE = {
    **_HSV, **_LAB,
    **smoothed("vo", f"({_HSR[0]}) union ({_LAR[0]}) union select frame, y, x from px where b > r*1.2 and b > g*1.1 and b > 50", 3),
    **smoothed("vl", f"({_HSR[1]}) union ({_LAR[1]}) union select frame, y, x from px where g > r*1.1 and g > b*1.1 and g > 30", 3),
    **smoothed("vw", f"({_HSR[2]}) intersect ({_LAR[2]})", 2),
    "v1": _ranked("vo", "vl", "vw")[0], "v2": _ranked("vo", "vl", "vw")[1],
    "vn": "select frame, y, x from px except select * from v1 except select * from v2 except select * from vw",
    "vd": dilated("select * from v1", 2), "ve": dilated("select * from v2", 2),
}


@query("segment_vote", masks_of(
    _VOTE, "select * from v1 union (select * from vn intersect select * from vd except select * from ve)",
    "select * from v2 union (select * from vn intersect select * from ve except select * from vd)", "select * from vw",
))
def segment_vote(spark, sf):
    return S.vote_masks(dense(spark, sf), ["frame"], W, H, size=3, specks=2, last_size=3, last_specks=2, reach=2)


#: Local variance from window sums along both axes; the border is mirrored.
_V5W = _VN.format(v="""select frame, yy as y, xx as x, greatest(s2/25e0 - (s1/25e0)*(s1/25e0), 0) as variance from (
    select frame, yy, xx, sum(a1) over v as s1, sum(a2) over v as s2 from (
      select frame, yy, xx, sum(raw - 2950e0) over h as a1, sum((raw - 2950e0)*(raw - 2950e0)) over h as a2 from MIRRORED
      window h as (partition by frame, yy order by xx range between 2 preceding and 2 following)) where xx between 0 and 7
    window v as (partition by frame, xx order by yy range between 2 preceding and 2 following)) where yy between 0 and 7""".replace("MIRRORED", _mirror_sql(2)))


def _cleaned_land(name, mask):
    ctes = {f"{name}_d": dilated(mask, 2), f"{name}_c": eroded_open_border(f"select * from {name}_d", 2), **large(name, f"select * from {name}_c", 3)}
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + f" select frame, y, x, (frame, y, x) in (select (frame, y, x) from {name}) as land_mask from px"


def _clean(method):
    return lambda spark, sf: S.temperature_mask(dense(spark, sf), ["frame"], method, 22.0, W, H, 3, 5, 3)


query("segment_infrared", _cleaned_land("tl", "select frame, y, x from px where raw/10-273.15 > 22"))(_clean("temperature"))
query("segment_infrared_variance", _cleaned_land("tv", f"select frame, y, x from ({_V5W}) where vn >= 0.3"))(_clean("variance"))
query("segment_infrared_combined", _cleaned_land("tc", f"select frame, y, x from ({_V5W}) join px using (frame, y, x) where raw/10-273.15 > 22 or vn > 0.3"))(_clean("combined"))


_SCORE = ORACLE["segment_infrared_adaptive"].removeprefix(with_views("px ")[:-3])
_ADAPT = {
    "ad": dilated(f"select frame, y, x from ({_SCORE}) where score > 0.5", 3), "ac": eroded_open_border("select * from ad", 3), **large("ak", "select * from ac", 5), **filled("af", "select * from ak", 3),
    "tad": dilated("select frame, y, x from px except select * from af", 2), "tac": eroded_open_border("select * from tad", 2), **large("ta", "select * from tac", 3),
}


query("segment_infrared_adaptive_mask", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _ADAPT.items()) + " select frame, y, x, (frame, y, x) in (select (frame, y, x) from ta) as land_mask from px")(_clean("adaptive"))


@query(
    "ocean_features",
    f"""select frame, y, x, raw > m + 1.5*s as warm, raw < m - 1.5*s as cold, gm > p as front from (select frame, y, x, raw, sqrt(gx*gx+gy*gy) as gm from px join ({SOBEL}) using (frame, y, x) where ocean)
      join (select frame, avg(raw) as m, stddev_pop(raw-2950e0) as s, quantile_cont(sqrt(gx*gx+gy*gy), 0.9) as p from px join ({SOBEL}) using (frame, y, x) where ocean group by frame) using (frame)""",
)
def ocean_features(spark, sf):
    return S.ocean_features(dense(spark, sf), ["frame"])


@query("apply_mask_stats", """select frame, count(*) filter (ocean) as ocean_px, count(*) filter (land) as land_px, round(avg(raw) filter (ocean)/10-273.15,6) as ocean_mean,
  round(avg(raw) filter (land)/10-273.15,6) as land_mean, round(max(raw) filter (ocean)/10-273.15,6) as ocean_max from px group by frame""")
def apply_mask_stats(spark, sf):
    o, l_ = C("ocean"), C("land")
    t = C("raw")
    d = pixels(spark, sf).groupBy("frame").agg(
        F.count(F.when(o, 1)).alias("ocean_px"),
        F.count(F.when(l_, 1)).alias("land_px"),
        (F.avg(F.when(o, t)) / 10 - 273.15).alias("ocean_mean"),
        (F.avg(F.when(l_, t)) / 10 - 273.15).alias("land_mean"),
        (F.max(F.when(o, t)) / 10 - 273.15).alias("ocean_max"),
    )
    return rounded(d)


_Z = "select p.frame, p.y, p.x from px p join (select frame, avg(raw) as m, stddev_pop(raw-2950e0) as s from px where ocean group by frame) using (frame) where ocean and (raw-m)/(s+1e-7) < -1.5"
_ZM = eroded(dilated(dilated(eroded(_Z.replace('-1.5', '0.5'), 1), 1), 1), 1)
_ZC = ", ".join(f"{k} AS ({v})" for k, v in components("zz", _ZM, 4).items())


@query("zscore_detect", f"WITH {_ZC} select frame, region, count(*) as area from zz group by frame, region having count(*) >= 1")
def zscore_detect(spark, sf):
    return D.zscore_detect(dense(spark, sf), SMALL, 1, ["frame"], 0.5).select("frame", "region", "area")


@query("zscore_cold", _Z)
def zscore_cold(spark, sf):
    return D.zscore_cold(dense(spark, sf), ["frame"])


def confidence(spark, sf):
    return D.confidence(by_directory(spark, sf), SMALL, sigma=1.0)


from .rasters import _GW  # noqa: E402

_CV = """select p.frame, p.y, p.x, case when ocean and raw < m - 5 then (m - raw)/top*exp(-d/20) else 0 end as raw from px p join med using (frame) join dist using (frame, y, x)
  join (select p.frame, max(greatest(m-raw,0)) as top from px p join med using (frame) where ocean group by p.frame) using (frame)"""
_CMAP = f"""select p.frame, p.y, p.x, sum(q.raw * ({_GW}::double[])[(q.yy-p.y+5)::int] * ({_GW}::double[])[(q.xx-p.x+5)::int]) as conf from px p
  join {_mirror_sql(4).replace('from px)', f'from ({_CV}))')} q on q.frame = p.frame and abs(q.yy - p.y) <= 4 and abs(q.xx - p.x) <= 4 group by p.frame, p.y, p.x"""


@query("confidence_map", f"select frame, y, x, round(conf,6) as confidence from ({_CMAP})")
def confidence_map(spark, sf):
    return confidence(spark, sf).select("frame", "y", "x", F.round("confidence", 6).alias("confidence"))


@query(
    "composite_map",
    f"""select media, y, x, sum(hit)::bigint as frequency, round(sum(hit)/any_value(nf),6) as persistence, round(sum(conf)/any_value(nf),6) as mean_confidence from (
      select p.media, p.y, p.x, (c.frame is not null)::int as hit, conf from px p join ({_CMAP}) using (frame, y, x) left join cold c using (frame, y, x))
      join (select media, count(distinct frame)::double as nf from px group by media) using (media) group by media, y, x""",
)
def composite_map(spark, sf):
    p = by_directory(spark, sf)
    cold = D.cold_pixels(p, D.baselines(p, replace(SMALL, window=0)), [0.5]).select(*KEYS, "y", "x", F.lit(True).alias("hit"))
    flags = confidence(spark, sf).join(cold, [*KEYS, "y", "x"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    n = pixels(spark, sf).select(*KEYS).distinct().groupBy("media").agg(F.count(F.lit(1)).alias("n_frames"))
    return rounded(D.composite(flags, n, ["media"]))


# ---- whole surveys -----------------------------------------------------------------------------

_NAMED = """case when f.frame % 16 < 8 then 'north' else 'south' end as survey, concat(100 + f.frame % 8, 'MEDIA') as media, f.frame // 16 as frame"""
VIEWS["flown"] = f"""select *, row_number() over (order by survey, media, frame, region) - 1 as ord from (
  select {_NAMED}, f.region, f.area, f.anomaly, lat + (e*sin(radians(-heading)) + n*cos(radians(-heading)))/111320 as plat,
    lon + (e*cos(radians(-heading)) - n*sin(radians(-heading)))/(111320*cos(radians(lat))) as plon, f.area*gsd*gsd as area_m2
  from (select f.*, c.lat, c.lon, c.heading, 2*c.altitude*tan(radians(22.5))/8 as gsd, (cx-4)*2*c.altitude*tan(radians(22.5))/8 as e, -(cy-4)*2*c.altitude*tan(radians(22.5))/8 as n
    from found f join captures c using (frame)) f)"""


def survey(spark, sf, **more):
    from ..plans.survey import FRAME_KEY, run_survey

    px = named_frames(pixels(spark, sf)).repartition(*FRAME_KEY)
    return run_survey(px, named_frames(captures(spark, sf)), replace(SMALL, window=0, dedup_m=60.0), **more)


@query(
    "run_survey",
    "select survey, media, frame, region, ord, area, round(plat,8) as plat, round(plon,8) as plon, round(area_m2,4) as area_m2 from flown",
)
def run_survey_detections(spark, sf):
    """Both surveys in one call; frame numbers repeat in every directory."""
    det, _ = survey(spark, sf)
    return det.select("survey", "media", "frame", "region", "ord", "area", F.round("plat", 8).alias("plat"), F.round("plon", 8).alias("plon"), F.round("area_m2", 4).alias("area_m2"))


VIEWS["flown_r"] = """select 1::bigint as k, [{'ord': ord, 'lat': plat, 'lon': plon, 'cnt': 1, 'area': area_m2}] as ls from flown where ord = 0 union all
  select r.k + 1, case when r.hit is null then list_append(r.ls, {'ord': s.ord, 'lat': s.plat, 'lon': s.plon, 'cnt': 1, 'area': s.area_m2})
    else list_transform(r.ls, lambda l, i: case when i = r.hit then {'ord': l.ord, 'lat': l.lat, 'lon': l.lon, 'cnt': l.cnt + 1, 'area': greatest(l.area, s.area_m2)} else l end) end
  from (select r.k, r.ls, list_min(list_filter(range(1, len(r.ls) + 1), lambda j: HAV < 60)) as hit
    from flown_r r join flown s on s.ord = r.k) r join flown s on s.ord = r.k""".replace("HAV", hav_sql("s.plat", "s.plon", "r.ls[j].lat", "r.ls[j].lon"))


@query(
    "run_campaign",
    "select u.ord as location, round(u.lat,8) as lat, round(u.lon,8) as lon, u.cnt as detection_count, round(u.area,4) as area_m2 from (select unnest(ls) as u from (select ls from flown_r order by k desc limit 1))",
)
def run_campaign(spark, sf):
    """Unique locations over all surveys, in the order of survey, directory, frame and region."""
    _, places = survey(spark, sf)
    return places.select("location", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "detection_count", F.round("area_m2", 4).alias("area_m2"))
