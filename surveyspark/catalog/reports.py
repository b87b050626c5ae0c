"""Joins on frames, time-of-day statistics, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, rings, text
from ..operators import frames as FR
from ..operators import spatial
from ..operators import temporal as T
from ..operators.ordered import exact_quantiles, with_index
from ..operators.state import unprocessed
from ..plans.temporal_bias import temporal_bias
from ..sources.tables import captures, detections, table
from .base import query
from .baselines import rounded
from .spatials import points

C = F.col


# ---- frame joins -------------------------------------------------------------------------------


def _rgb(spark, sf):
    return captures(spark, sf).filter("event_type <> 'error'").select("flight", "frame", F.concat(F.lit("MAX_"), "frame").alias("rgb"))


def _infrared(spark, sf):
    return captures(spark, sf).filter("event_type <> 'signup'").select("flight", "frame", F.concat(F.lit("IRX_"), "frame").alias("infrared"))


@query("pair_frames", "select flight, frame, 'MAX_' || frame as rgb, 'IRX_' || frame as infrared from captures where event_type not in ('error','signup')")
def pair_frames(spark, sf):
    return FR.pair(_rgb(spark, sf), _infrared(spark, sf), ["flight", "frame"])


@query("unpaired_frames", "select flight, count(*) as n from captures where event_type = 'signup' group by flight")
def unpaired_frames(spark, sf):
    return FR.unpaired(_rgb(spark, sf), _infrared(spark, sf), ["flight", "frame"]).groupBy("flight").agg(F.count(F.lit(1)).alias("n"))


@query(
    "detections_with_capture",
    "select frame, flight, strftime(ts,'%Y-%m-%d %H:%M:%S') as taken, altitude, area_m2 from dets",
)
def detections_with_capture(spark, sf):
    d = detections(spark, sf).select("frame", "area_m2")
    c = captures(spark, sf).select("frame", "flight", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("taken"), "altitude")
    return d.join(c, "frame")


@query(
    "pixel_align_join",
    "select p.frame, p.y, p.x, p.raw, s.r, s.g, s.b from px p join (select frame, y//2 as y, x//2 as x, avg(r) as r, avg(g) as g, avg(b) as b from px group by frame, y//2, x//2) s on s.frame = p.frame and s.y = p.y//2 and s.x = p.x//2",
)
def pixel_align_join(spark, sf):
    """Infrared pixels with the colour of the coarser image, resampled by nearest block."""
    from .rasters import dense
    from ..operators.raster import downsample

    p = dense(spark, sf)
    small = downsample(p, ["r", "g", "b"], ["frame"], 2).select("frame", C("y").alias("by"), C("x").alias("bx"), "r", "g", "b")
    t = p.select("frame", "y", "x", "raw", F.expr("cast(y div 2 as int)").alias("by"), F.expr("cast(x div 2 as int)").alias("bx"))
    return t.join(small, ["frame", "by", "bx"]).drop("by", "bx")


_TAPS = "(select i, greatest(least(lo + k, 5), 0) as s, case k when 0 then 1 - (mid - lo) else mid - lo end as w from (select i, mid, floor(mid) as lo from (select i, (i + 0.5e0)*6/8 - 0.5 as mid from (select unnest(range(8)) as i))), (select unnest(range(2)) as k))"


@query(
    "pixel_align_bilinear",
    f"""select p.frame, p.y, p.x, any_value(p.raw) as raw, round(sum(q.r*ty.w*tx.w),6) as r, round(sum(q.g*ty.w*tx.w),6) as g, round(sum(q.b*ty.w*tx.w),6) as b
      from px p join {_TAPS} ty on ty.i = p.y join {_TAPS} tx on tx.i = p.x join px q on q.frame = p.frame and q.y - 1 = ty.s and q.x - 1 = tx.s group by p.frame, p.y, p.x""",
)
def pixel_align_bilinear(spark, sf):
    """Infrared pixels with the colour of the centre crop of 6 x 6 pixels, enlarged to 8 x 8."""
    from .rasters import dense
    from ..operators.raster import resample

    p = dense(spark, sf)
    crop = p.filter("y between 1 and 6 and x between 1 and 6").select("frame", (C("y") - 1).alias("y"), (C("x") - 1).alias("x"), "r", "g", "b")
    rgb = resample(crop, ["r", "g", "b"], ["frame"], (6, 6), (8, 8))
    return p.select("frame", "y", "x", "raw").join(rgb, ["frame", "y", "x"]).select("frame", "y", "x", "raw", *[F.round(c, 6).alias(c) for c in ("r", "g", "b")])


@query(
    "altitude_consistency",
    """select flight, count(*) as n, count(*) filter (abs(d) >= 1) as mismatches, round(avg(d),6) as mean_diff, round(stddev_pop(d),6) as std_diff
      from (select flight, altitude - (altitude + (frame % 7 - 3) * 0.5e0) as d from captures) group by flight""",
)
def altitude_consistency(spark, sf):
    """Altitude of one extractor against another's, frame by frame."""
    a = captures(spark, sf).select("flight", "frame", "altitude")
    b = captures(spark, sf).select("frame", (C("altitude") + (C("frame") % 7 - 3) * 0.5).alias("altitude_b"))
    d = C("altitude") - C("altitude_b")
    return rounded(
        a.join(b, "frame").groupBy("flight").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(d) >= 1, 1)).alias("mismatches"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff")
        )
    )


@query(
    "model_for_area",
    """select p_partkey, coalesce(case when split_part(p_name,' ',1) in ('red','blue') then split_part(p_name,' ',1) || '_model' end,
      case when p_size > 25 then split_part(p_name,' ',2) || '_model' end, 'default_model') as model from part""",
)
def model_for_area(spark, sf):
    """Area model, else parent-area model, else the default."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.split("p_name", " ")[0].alias("area"), F.split("p_name", " ")[1].alias("parent"))
    registry = p.select("area").distinct().filter(C("area").isin("red", "blue")).withColumn("m1", F.concat("area", F.lit("_model")))
    parents = p.filter("p_size > 25").select("parent", "p_size").distinct().withColumn("m2", F.concat("parent", F.lit("_model")))
    d = p.join(registry, "area", "left").join(parents, ["parent", "p_size"], "left")
    return d.select("p_partkey", F.coalesce("m1", "m2", F.lit("default_model")).alias("model"))


@query("already_processed", "select flight, frame from captures where flight not in (select flight from captures where event_type = 'error' and ts < timestamp '2024-01-02')")
def already_processed(spark, sf):
    c = captures(spark, sf)
    done = c.filter("event_type = 'error' and ts < '2024-01-02'").select("flight").distinct()
    return unprocessed(c.select("flight", "frame"), done, ["flight"])


@query("collect_campaign", "select flight, frame, area_m2, cast(null as double) as anomaly from dets where flight % 2 = 0 union all select flight, frame, area_m2, anomaly from dets where flight % 2 = 1")
def collect_campaign(spark, sf):
    """Directories whose records differ in columns, appended by name."""
    d = detections(spark, sf)
    a = d.filter("flight % 2 = 0").select("flight", "frame", "area_m2")
    b = d.filter("flight % 2 = 1").select("flight", "frame", "area_m2", "anomaly")
    return a.unionByName(b, allowMissingColumns=True)


@query("polygon_min_points", "select count(*) as n from dets")
def polygon_min_points(spark, sf):
    d = detections(spark, sf).select(rings.square(C("lon"), C("lat"), C("half")).alias("ring"))
    return d.filter(F.size("ring") > 3).agg(F.count(F.lit(1)).alias("n"))


@query("min_sample_guard", "select label, count(*) as n, count(*) >= 40 as enough from embeddings group by label")
def min_sample_guard(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "embeddings").groupBy("label").agg(n.alias("n"), (n >= 40).alias("enough"))


@query(
    "placemark_number",
    "select frame, row_number() over (order by frame) as number from dets",
)
def placemark_number(spark, sf):
    return with_index(detections(spark, sf).select("frame"), [], "frame").select("frame", (C("idx") + 1).alias("number"))


# ---- time of day -------------------------------------------------------------------------------


def tod(spark, sf):
    return captures(spark, sf).select("frame", "flight", "ts", (C("event_type") == "purchase").alias("detected"))


def _hist_sql(width, n):
    return f"""(select b.bin, coalesce(c, 0)::bigint as captures, coalesce(d, 0)::bigint as detections from (select unnest(range({n})) as bin) b left join (
      select least(floor((h-6)/{width})::int, {n-1}) as bin, count(*) as c, sum((event_type='purchase')::int) as d
      from (select *, hour(ts)+minute(ts)/60e0 as h from captures) where h between 6 and 18 group by 1) using (bin))"""


H1, H05 = _hist_sql(1, 12), _hist_sql(0.5, 24)


@query("hour_histogram", f"select bin, captures, detections from {H05}")
def hour_histogram(spark, sf):
    return T.histograms(tod(spark, sf), 0.5)


@query(
    "detection_rate",
    f"""select bin, 6.25e0 + bin*0.5e0 as centre, round(case when captures > 0 then detections/captures::double*100 else 0 end,6) as rate from {H05}""",
)
def detection_rate(spark, sf):
    return T.rates(T.histograms(tod(spark, sf), 0.5), 0.5).select("bin", "centre", F.round("rate", 6).alias("rate"))


@query(
    "detection_rate_summary",
    f"""select round(avg(rate) filter (rate > 0),6) as mean_rate, arg_max(centre, rate) as peak_centre from (
      select 6.25e0 + bin*0.5e0 as centre, case when captures > 0 then detections/captures::double*100 else 0 end as rate from {H05})""",
)
def detection_rate_summary(spark, sf):
    r = T.rates(T.histograms(tod(spark, sf), 0.5), 0.5)
    return r.agg(F.round(F.avg(F.when(C("rate") > 0, C("rate"))), 6).alias("mean_rate"), F.max_by("centre", F.struct("rate", -C("bin"))).alias("peak_centre"))


_CHI = f"""(select sum(pow(detections - captures*p,2)/(captures*p) + pow((captures-detections) - captures*(1-p),2)/(captures*(1-p))) as chi2, count(*)-1 as dof, any_value(n) as n
  from {H1}, (select sum(captures) as n, sum(detections)/sum(captures)::double as p from {H1}) where captures > 0)"""


@query("chi_square_independence", f"select round(chi2,6) as chi2, dof, n::bigint as n from {_CHI}")
def chi_square(spark, sf):
    return rounded(T.chi_square(T.histograms(tod(spark, sf))).select("chi2", "dof", "n"))


@query("cramers_v", f"select round(sqrt(chi2/n),8) as cramers_v, round(sqrt(chi2/(n*2-1)),8) as cramers_v_compat from {_CHI}")
def cramers_v(spark, sf):
    return rounded(T.chi_square(T.histograms(tod(spark, sf))).select("cramers_v", "cramers_v_compat"), 8)


_KS = """(select max(abs(a-b)) as ks from (select sum(c) over w / sum(c) over () as a, sum(d) over w / sum(d) over () as b from (
  select hour(ts)*60+minute(ts) as m, count(*)::double as c, sum((event_type='purchase')::int)::double as d from captures group by 1) window w as (order by m)))"""


@query("ks_two_sample", f"select round(ks,8) as ks_statistic from {_KS}")
def ks_two_sample(spark, sf):
    d = tod(spark, sf).withColumn("minute", F.hour("ts") * 60 + F.minute("ts"))
    return rounded(T.ks_two_sample(d, "minute", "detected"), 8)


_PEAK = f"(select arg_max(6.5e0+bin, captures*100-bin) as pc, arg_max(6.5e0+bin, detections*100-bin) as pd from {H1})"


@query("peak_hours", f"select pc as peak_capture_hour, pd as peak_detection_hour, pd-pc as time_difference from {_PEAK}")
def peak_hours(spark, sf):
    return T.peaks(T.histograms(tod(spark, sf)))


@query(
    "temporal_bias",
    f"""select count(*) as n_images, sum((event_type='purchase')::int)::bigint as n_detections, count(distinct flight) as n_flights, round(any_value(chi2),6) as chi2, any_value(dof) as dof,
      round(any_value(ks),8) as ks_statistic, any_value(pc) as peak_capture_hour, any_value(pd) as peak_detection_hour,
      case when sqrt(any_value(chi2)/any_value(n)) < 0.1 then 'negligible' when sqrt(any_value(chi2)/any_value(n)) < 0.3 then 'small' else 'medium' end as effect from captures, {_CHI}, {_KS}, {_PEAK}""",
)
def temporal_bias_query(spark, sf):
    d = temporal_bias(tod(spark, sf))
    return d.select(
        "n_images", "n_detections", "n_flights", F.round("chi2", 6).alias("chi2"), "dof", F.round("ks_statistic", 8).alias("ks_statistic"),
        "peak_capture_hour", "peak_detection_hour", "effect",
    )


# ---- summaries ---------------------------------------------------------------------------------


@query(
    "flight_aggregate",
    """select flight, count(*) as images, sum((event_type='purchase')::int)::bigint as detections, count(distinct ts::date) as n_days,
      strftime(min(ts),'%Y-%m-%d') || ' to ' || strftime(max(ts),'%Y-%m-%d') as date_range from captures group by flight""",
)
def flight_aggregate(spark, sf):
    day = lambda a: F.date_format(a, "yyyy-MM-dd")
    return tod(spark, sf).groupBy("flight").agg(
        F.count(F.lit(1)).alias("images"),
        F.sum(C("detected").cast("int")).alias("detections"),
        F.countDistinct(F.to_date("ts")).alias("n_days"),
        F.concat_ws(" to ", day(F.min("ts")), day(F.max("ts"))).alias("date_range"),
    )


_SKIP = "(select c.*, row_number() over (partition by flight order by frame) - 1 as idx from captures c)"
_SUM = f"""count(*) as frames_total, count(*) filter (idx % 5 = 0) as frames_processed, count(*) filter (idx % 5 <> 0) as frames_skipped,
  count(*) filter (idx % 5 = 0 and event_type='purchase') as detections, round(coalesce(sum(value) filter (idx % 5 = 0 and event_type='purchase'),0),4) as total_area_m2,
  round(avg(-(0.5e0+value/100)) filter (idx % 5 = 0 and event_type='purchase'),6) as mean_anomaly"""


def _summary_columns():
    done = C("idx") % 5 == 0
    hit = done & (C("event_type") == "purchase")
    return [
        F.count(F.lit(1)).alias("frames_total"),
        F.count(F.when(done, 1)).alias("frames_processed"),
        F.count(F.when(~done, 1)).alias("frames_skipped"),
        F.count(F.when(hit, 1)).alias("detections"),
        F.round(F.coalesce(F.sum(F.when(hit, C("value"))), F.lit(0.0)), 4).alias("total_area_m2"),
        F.round(F.avg(F.when(hit, -(F.lit(0.5) + C("value") / 100))), 6).alias("mean_anomaly"),
    ]


def survey_rows(spark, sf):
    return with_index(captures(spark, sf).select("flight", "frame", "event_type", "value"), ["flight"], "frame")


@query("survey_summary", f"select {_SUM}, (select count(*) from fold) as unique_locations from {_SKIP}")
def survey_summary(spark, sf):
    unique = spatial.leaders(points(spark, sf), 10.0).agg(F.count(F.lit(1))).scalar()
    return survey_rows(spark, sf).agg(*_summary_columns()).withColumn("unique_locations", unique)


@query("campaign_rollup", f"select flight, {_SUM} from {_SKIP} group by rollup(flight)")
def campaign_rollup(spark, sf):
    return survey_rows(spark, sf).rollup("flight").agg(*_summary_columns())


@query(
    "anomaly_distribution",
    """select round(avg(anomaly),6) as mean, round(stddev_pop(anomaly),6) as std, round(min(anomaly),6) as min, round(max(anomaly),6) as max,
      round(quantile_cont(anomaly,0.5),6) as median, round(quantile_cont(anomaly,0.025),6) as lower, round(quantile_cont(anomaly,0.975),6) as upper from dets""",
)
def anomaly_distribution(spark, sf):
    d = detections(spark, sf)
    q = exact_quantiles(d, "anomaly", [0.025, 0.5, 0.975])
    q = q.agg(F.map_from_entries(F.collect_list(F.struct("p", "quantile")))).scalar()
    s = d.agg(F.avg("anomaly").alias("mean"), F.stddev_pop("anomaly").alias("std"), F.min("anomaly").alias("min"), F.max("anomaly").alias("max"))
    s = s.withColumn("q", q).select(
        "mean", "std", "min", "max", *[F.element_at("q", F.lit(p)).alias(n) for p, n in ((0.5, "median"), (0.025, "lower"), (0.975, "upper"))]
    )
    return rounded(s)


@query("anomaly_histogram", "select floor(anomaly/0.25)::bigint as bin, count(*) as n from dets group by 1")
def anomaly_histogram(spark, sf):
    return detections(spark, sf).groupBy(F.floor(C("anomaly") / 0.25).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("class_counts", "select l.label, count(e.vec_id) as n from (select unnest(range(12)) as label) l left join embeddings e using (label) group by l.label")
def class_counts(spark, sf):
    labels = spark.range(12).select(C("id").cast("int").alias("label"))
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(n, "label", "left").fillna(0, ["n"])
