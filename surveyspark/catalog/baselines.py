"""Frame histograms, baselines, history windows, frame selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import frames as FR
from ..operators.ordered import neighbours, with_index
from ..functions import geo
from ..functions.infrared import celsius
from ..sources.tables import captures, pixels
from .base import query

KEYS = ["media", "frame"]
R = F.round


def hist(spark, sf):
    return B.temp_hist(pixels(spark, sf), KEYS)


def rounded(df, digits=6, skip=()):
    return df.select(*[R(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query(
    "cold_frames",
    """select p.frame, count(*) as n_cold, round(avg((p.raw - m.m)/10), 6) as mean_anomaly,
       count(*) >= 5 as has_plume from cold p join med m using (frame) group by p.frame""",
)
def cold_frames(spark, sf):
    h = hist(spark, sf)
    base = h.groupBy(*KEYS).agg(F.percentile("raw", F.lit(0.5), F.col("n")).alias("m"))
    cold = h.join(base, KEYS).filter(F.col("raw") < F.col("m") - 5)
    return cold.groupBy("frame").agg(
        F.sum("n").alias("n_cold"),
        R(F.sum((F.col("raw") - F.col("m")) / 10 * F.col("n")) / F.sum("n"), 6).alias("mean_anomaly"),
        (F.sum("n") >= 5).alias("has_plume"),
    )


query("temp_hist", "select media, frame, raw, n from hist")(hist)


@query(
    "ocean_stats",
    """select media, frame, round(quantile_cont(raw,0.5)/10-273.15,6) as median, round(avg(raw)/10-273.15,6) as mean,
      round(stddev_pop(raw)/10,6) as std, round(quantile_cont(raw,0.25)/10-273.15,6) as q25,
      round(quantile_cont(raw,0.75)/10-273.15,6) as q75, round(quantile_cont(raw,0.9)/10-273.15,6) as q90,
      round(min(raw)/10-273.15,6) as min, round(max(raw)/10-273.15,6) as max,
      round((quantile_cont(raw,0.75)-quantile_cont(raw,0.25))/10,6) as iqr, count(*) as n
      from px where ocean group by media, frame""",
)
def ocean_stats(spark, sf):
    return rounded(B.ocean_stats(hist(spark, sf), KEYS))


def _pct(name, p):
    @query(name, f"select media, frame, round(quantile_cont(raw,{p})/10-273.15,6) as baseline from px where ocean group by all")
    def run(spark, sf):
        return rounded(B.percentile_baseline(hist(spark, sf), KEYS, p))


_pct("baseline_median", 0.5)
_pct("baseline_percentile", 0.75)
_pct("baseline_percentile_80", 0.8)
_pct("baseline_percentile_90", 0.9)

_TRIM = """select p.media, p.frame, avg(raw)/10-273.15 as baseline from px p join med m using (frame)
  where p.ocean and p.raw >= m.q25 group by all"""
_MODAL = """select media, frame, (lo + (bin + 0.5e0) * (hi - lo) / 50)/10 - 273.15 as baseline from (
  select media, frame, lo, hi, bin, row_number() over (partition by media, frame order by c desc, bin) as rk from (
   select media, frame, lo, hi, bin, sum(n) as c from (
    select h.media, h.frame, n, lo, hi, least(cast(floor((raw - lo) * 50 / (hi - lo)) as int), 49) as bin
    from hist h join (select frame, case when min(raw)=max(raw) then min(raw)-5e0 else min(raw)+0e0 end as lo,
                 case when min(raw)=max(raw) then max(raw)+5e0 else max(raw)+0e0 end as hi from hist group by frame) using (frame))
  group by all)) where rk = 1"""


@query("baseline_trimmed_mean", f"select media, frame, round(baseline,6) as baseline from ({_TRIM})")
def trimmed(spark, sf):
    return rounded(B.trimmed_mean_baseline(hist(spark, sf), KEYS))


@query("baseline_modal_peak", f"select media, frame, round(baseline,6) as baseline from ({_MODAL})")
def modal(spark, sf):
    return rounded(B.modal_baseline(hist(spark, sf), KEYS))


@query(
    "mad",
    """select p.media, p.frame, round(any_value(m.m)/10-273.15,6) as median,
      round(quantile_cont(abs(p.raw-m.m),0.5)/10,6) as mad from px p join med m using (frame) where p.ocean group by all""",
)
def mad(spark, sf):
    return rounded(B.mad(hist(spark, sf), KEYS))


_POOL = """select f.media, f.frame, h.raw, h.n from ocean_frames f join ocean_frames g
  on g.media = f.media and g.idx between f.idx - 4 and f.idx join hist h on h.frame = g.frame"""
_MOVING = f"""select media, frame, quantile_cont(raw, 0.5)/10 - 273.15 as baseline
  from (select media, frame, raw, unnest(range(n)) from ({_POOL})) group by media, frame"""


@query("moving_baseline", f"select media, frame, round(baseline,6) as baseline from ({_MOVING})")
def moving_baseline(spark, sf):
    return rounded(B.moving_baseline(hist(spark, sf), ["media"], 5))


@query(
    "moving_mean_std",
    f"""select media, frame, round(sum(raw*n)/sum(n)/10-273.15,6) as mean,
      round(sqrt(sum(n*(raw-2731e0)*(raw-2731e0))/sum(n) - pow(sum(n*(raw-2731e0))/sum(n),2))/10,6) as std
      from ({_POOL}) group by media, frame""",
)
def moving_mean_std(spark, sf):
    return rounded(B.moving_mean_std(hist(spark, sf), ["media"], 5))


@query(
    "baseline_stability",
    f"""select media, round(avg(baseline),6) as mean, round(stddev_pop(baseline),6) as std, round(min(baseline),6) as min,
      round(max(baseline),6) as max, round(max(baseline)-min(baseline),6) as range, count(*) as n_frames
      from ({_MOVING}) group by media""",
)
def baseline_stability(spark, sf):
    return rounded(B.stability(B.moving_baseline(hist(spark, sf), ["media"], 5), ["media"]))


_CONT = """select media, frame, idx, md, abs(md - lag(md) over w) as temp_jump,
  case when idx >= 2 then abs(md - avg(md) over (partition by media order by idx rows between 4 preceding and 1 preceding)) end as deviation
  from (select f.media, f.frame, f.idx, m.m/10 - 273.15 as md from ocean_frames f join med m using (frame))
  window w as (partition by media order by idx)"""


def medians(spark, sf):
    return B.percentile_baseline(hist(spark, sf), KEYS, 0.5, out="median")


@query("temp_jump", f"select media, frame, round(temp_jump,6) as temp_jump, coalesce(temp_jump > 2.0, false) as jumped from ({_CONT})")
def temp_jump(spark, sf):
    d = B.continuity(medians(spark, sf), ["media"])
    return d.select("media", "frame", R("temp_jump", 6).alias("temp_jump"), F.coalesce(F.col("temp_jump") > 2.0, F.lit(False)).alias("jumped"))


@query(
    "running_deviation",
    f"""select media, frame, round(deviation,6) as deviation,
      coalesce(temp_jump > 2.0 or deviation > 3.0, false) as has_discontinuity from ({_CONT})""",
)
def running_deviation(spark, sf):
    d = B.continuity(medians(spark, sf), ["media"])
    return d.select("media", "frame", R("deviation", 6).alias("deviation"), "has_discontinuity")


@query(
    "hist_equalise",
    """select frame, raw, round((c - n) / t, 6) as cdf from (select frame, raw, n, sum(n) over (partition by frame order by raw) as c,
      sum(n) over (partition by frame) as t from hist)""",
)
def hist_equalise(spark, sf):
    """Empirical CDF of each count in its frame; a frame's histogram is bounded by the sensor's counts."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame")
    below = F.coalesce(F.sum("n").over(w.orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return B.temp_hist(pixels(spark, sf, colocate=["frame"]), ["frame"]).select(
        "frame", "raw", R(below / F.sum("n").over(w), 6).alias("cdf")
    )


# ---- frame selection ----------------------------------------------------------------------------

_IDX = "select frame, flight, row_number() over (partition by flight order by frame) - 1 as idx, count(*) over (partition by flight) as n from captures"


def frames(spark, sf):
    return captures(spark, sf).select("flight", "frame")


@query("frame_skip", f"select flight, frame, idx from ({_IDX}) where idx % 5 = 0")
def frame_skip(spark, sf):
    return FR.every_nth(frames(spark, sf), 5, ["flight"])


@query("frame_cap", f"select flight, frame, idx from ({_IDX}) where idx < 20")
def frame_cap(spark, sf):
    return FR.first_k(frames(spark, sf), 20, ["flight"])


@query("ordered_frames", f"select flight, frame, idx from ({_IDX})")
def ordered_frames(spark, sf):
    return with_index(frames(spark, sf), ["flight"], "frame")


@query(
    "sample_distributed",
    f"""select distinct a.flight, a.frame from ({_IDX}) a, (select unnest(range(10)) as i) s
      where a.n <= 10 or a.idx = cast(floor(s.i * (a.n - 1) / 9e0) as bigint)""",
)
def sample_distributed(spark, sf):
    return FR.sample_distributed(frames(spark, sf), 10, ["flight"]).select("flight", "frame")


@query("sample_increment", f"select flight, frame from ({_IDX}) where idx % 7 = 0 and idx < 7 * 6")
def sample_increment(spark, sf):
    return FR.sample_increment(frames(spark, sf), 7, 6, ["flight"]).select("flight", "frame")


@query("sample_random", "select flight, frame from (select flight, frame, ((frame % 1000003) * 7919 + 42 * 104729) % 1000003 as h from captures) order by (h*h + 12345) % 1000003, frame limit 50")
def sample_random(spark, sf):
    return FR.sample_random(frames(spark, sf), 50)


@query(
    "frame_gaps",
    """select flight, round(avg(gap),6) as mean_gap, min(gap) as min_gap, max(gap) as max_gap from (
      select flight, lead(frame) over (partition by flight order by frame) - frame as gap from captures) where gap is not null group by flight""",
)
def frame_gaps(spark, sf):
    return FR.gaps(frames(spark, sf), ["flight"]).groupBy("flight").agg(
        R(F.avg("gap"), 6).alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap")
    )


HAV = """2 * 6371000e0 * atan2(sqrt({a}), sqrt(1 - {a}))"""


def hav_sql(la1, lo1, la2, lo2):
    a = f"(pow(sin(radians({la2}-({la1}))/2),2) + cos(radians({la1}))*cos(radians({la2}))*pow(sin(radians({lo2}-({lo1}))/2),2))"
    return HAV.format(a=a)


_LAGGED = """select *, lag(lat) over w as plat, lag(lon) over w as plon, lag(heading) over w as ph from captures
  window w as (partition by flight order by frame)"""


def lagged(spark, sf):
    d = with_index(captures(spark, sf).select("flight", "frame", "lat", "lon", "altitude", "heading"), ["flight"], "frame")
    return neighbours(d, ["flight"], {"prev": lambda w: F.lag(F.struct("lat", "lon", "heading")).over(w)})


@query(
    "consecutive_overlap",
    f"""select flight, frame, round(d,4) as distance_m, round(case when d >= gw then 0 else gw - d end,4) as overlap_m,
      round(case when d >= gw then 0 else (gw - d)/gw*100 end,4) as overlap_pct from (
      select *, {hav_sql('plat','plon','lat','lon')} as d, 2*altitude*tan(radians(22.5)) as gw from ({_LAGGED}) where plat is not null)""",
)
def consecutive_overlap(spark, sf):
    d = lagged(spark, sf).filter("prev is not null")
    dist = geo.haversine_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    d = d.withColumn("d", dist).withColumn("gw", geo.ground_width(F.col("altitude")))
    o = geo.overlap(F.col("d"), F.col("gw"))
    return rounded(d.select("flight", "frame", F.col("d").alias("distance_m"), o["overlap_m"].alias("overlap_m"), o["overlap_pct"].alias("overlap_pct")), 4)


@query(
    "heading_change",
    f"""select flight, frame, turn, abs(turn) > 15 as rapid from (select flight, frame,
      case when ((heading-ph)%360+360)%360 > 180 then ((heading-ph)%360+360)%360-360 else ((heading-ph)%360+360)%360 end as turn
      from ({_LAGGED}) where ph is not null)""",
)
def heading_change(spark, sf):
    d = lagged(spark, sf).filter("prev is not null")
    t = geo.turn_deg(F.col("heading"), F.col("prev.heading"))
    return d.select("flight", "frame", t.alias("turn"), (F.abs(t) > 15).alias("rapid"))


@query("has_gps", "select count(*) as n from captures where lat is not null and lon is not null")
def has_gps(spark, sf):
    return captures(spark, sf).filter("lat is not null and lon is not null").agg(F.count(F.lit(1)).alias("n"))
