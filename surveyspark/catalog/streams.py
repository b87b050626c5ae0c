"""Streams drained to completion over the event log."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import state
from ..sources import tables as TB
from ..streaming import streams as S
from .base import query
from .baselines import _CONT, _MOVING, KEYS, hist, medians
from .files import _state_folder
from .spatials import R, shown

C = F.col


def events(spark, sf):
    """The event log as a stream of captures."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = S.read_frames(spark, sf, schema, "events.parquet")
    return e.select(C("event_id").alias("frame"), C("user_id").alias("flight"), C("ts").cast("timestamp").alias("ts"), (C("event_type") == "purchase").alias("detected"), "value")


def stamps(d):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return d.select(*[F.date_format(c, fmt).alias(c) if t == "timestamp" else C(c) for c, t in d.dtypes])


def listing(spark, sf, kind, keep="true"):
    """Paths of a survey's files as they were listed, with the time of each."""
    name = F.format_string(f"/survey/%s/{kind}", C("media"), C("frame"))
    d = TB.directories(TB.captures(spark, sf)).filter(keep)
    return d.select(name.alias("path"), C("ts").cast("timestamp").alias("ts"))


def numbered(paths):
    """Directory and frame number from the path."""
    media = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return paths.select(F.nullif(media, F.lit("")).alias("media"), F.nullif(F.regexp_extract("path", r"_(\d+)\.", 1), F.lit("")).cast("long").alias("frame"), "ts", "path")


_PATH = "concat('/survey/', 100 + event_id % 8, '/{0}_', lpad(event_id::varchar, greatest(4, length(event_id::varchar))::int, '0'), '.{1}')"
_RGB, _IRX = _PATH.format("MAX", "JPG"), _PATH.format("IRX", "irg")


@query("stream_frames", f"select (100 + event_id % 8)::varchar as media, event_id as frame, {_RGB} as path from events")
def stream_frames(spark, sf):
    """A listing of RGB files picked up file by file."""
    f = _state_folder(spark)
    d = numbered(landed(spark, listing(spark, sf, "MAX_%04d.JPG"), f"{f}/in"))
    return S.run_to_parquet(d.select("media", "frame", "path"), f)


@query(
    "stream_paired_frames",
    f"""select (100 + event_id % 8)::varchar as media, event_id as frame, case when event_id % 5 <> 0 then {_RGB} end as rgb_path, case when event_id % 7 <> 0 then {_IRX} end as infrared_path
      from events where event_id % 5 <> 0 or event_id % 7 <> 0""",
)
def stream_paired_frames(spark, sf):
    """RGB and infrared listings joined as they land in any order; a fifth and a seventh of the files never come."""
    f = _state_folder(spark)
    rgb = landed(spark, listing(spark, sf, "MAX_%04d.JPG", "frame % 5 <> 0"), f"{f}/rgb")
    infrared = landed(spark, listing(spark, sf, "IRX_%04d.irg", "frame % 7 <> 0").withColumn("ts", C("ts") + F.expr("interval 2 seconds")), f"{f}/irx")
    late = any_order(spark, f"{f}/rgb", f"{f}/irx")
    return S.drain(lambda a, b: S.paired_frames(numbered(a), numbered(b), late=late), [rgb, infrared], f)


def _win(width, slide):
    """All windows that hold an event; the last ones are delivered when the stream is closed."""
    n = width // slide
    return f"""select strftime(s,'%Y-%m-%d %H:%M:%S') as start, strftime(s + interval {width} minute,'%Y-%m-%d %H:%M:%S') as "end", count(*) as captures, sum((event_type='purchase')::int)::bigint as detections
      from (select event_type, time_bucket(interval {slide} minute, ts) - interval {slide} minute * k as s from captures, (select unnest(range({n})) as k)) group by s"""


@query("stream_hourly_rate", _win(30, 30))
def stream_hourly_rate(spark, sf):
    return stamps(S.drain(S.hourly_rate, events(spark, sf), _state_folder(spark)))


@query("stream_sliding_rate", _win(60, 30))
def stream_sliding_rate(spark, sf):
    return stamps(S.drain(lambda e: S.hourly_rate(e, "60 minutes", "30 minutes"), events(spark, sf), _state_folder(spark)))


@query(
    "session_flights",
    """select flight, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start, count(*) as captures from (select flight, ts, sum(gap) over (partition by flight order by ts) as sid from (
      select flight, ts, coalesce((ts - lag(ts) over (partition by flight order by ts)) > interval 20 minute, true)::int as gap from captures)) group by flight, sid""",
)
def session_flights(spark, sf):
    d = S.drain(S.sessions, events(spark, sf), _state_folder(spark))
    return stamps(d).select("flight", "start", "captures")


@query("stream_skip_processed", "select distinct frame from captures")
def stream_skip_processed(spark, sf):
    e = events(spark, sf).select("frame", "ts")
    return S.run_to_parquet(S.skip_processed(e.union(e)), _state_folder(spark)).select("frame")


FILES = 8


def landed(spark, d, folder):
    """A batch table as unordered files, of which a stream picks up one a trigger."""
    d.repartition(FILES).write.parquet(folder)
    return S.read_frames(spark, folder, d.schema, files_per_trigger=1)


def any_order(spark, *folders):
    """The time between the first and the last row of landed files: they come in no order at all, so the watermark
    waits for as long as the survey lasts."""
    ends = [spark.read.parquet(f).agg(F.min("ts").alias("a"), F.max("ts").alias("z")) for f in folders]
    r = functools.reduce(DataFrame.union, ends).agg(F.max(F.unix_timestamp("z")) - F.min(F.unix_timestamp("a"))).first()
    return f"{(r[0] or 0) + 1} seconds"


def timed(d):
    """Frames a minute apart."""
    return d.withColumn("ts", F.timestamp_seconds(C("frame") * 60 + 1_700_000_000))


@query("stream_moving_baseline", f"select media, frame, round(baseline,6) as baseline from ({_MOVING})")
def stream_moving_baseline(spark, sf):
    h = hist(spark, sf).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("raw", "n"))).alias("h"))
    h = timed(h.select(*KEYS, F.transform("h", lambda e: e["raw"]).alias("raws"), F.transform("h", lambda e: e["n"]).alias("counts")))
    f = _state_folder(spark)
    with S.keyed_state(spark):
        x = landed(spark, h, f"{f}/in")
        late = any_order(spark, f"{f}/in")
        d = S.drain(lambda x: S.moving_baseline(x, 5, 8, late), x, f)
    return d.withColumn("baseline", F.round("baseline", 6))


@query(
    "stream_glint_history",
    f"""select media, frame, round(temp_jump,6) as temp_jump, round(deviation,6) as deviation, coalesce(temp_jump > 2.0 or deviation > 3.0, false) as has_discontinuity from ({_CONT})""",
)
def stream_glint_history(spark, sf):
    f = _state_folder(spark)
    with S.keyed_state(spark):
        x = landed(spark, timed(medians(spark, sf)), f"{f}/in")
        late = any_order(spark, f"{f}/in")
        d = S.drain(lambda x: S.glint_history(x, stride=8, late=late), x, f)
    return d.select("media", "frame", F.round("temp_jump", 6).alias("temp_jump"), F.round("deviation", 6).alias("deviation"), "has_discontinuity")


@query("stream_dedup_locations", "select location, round(lat,8) as lat, round(lon,8) as lon, first_frame, last_frame, detection_count, area_m2, geometry_frame from fold")
def stream_dedup_locations(spark, sf):
    f = _state_folder(spark)
    d = timed(TB.detections(spark, sf).select(C("frame").alias("ord"), "frame", "lat", "lon", "area_m2"))
    v = S.dedup_locations(landed(spark, d, f"{f}/in"), f"{f}/set", R, any_order(spark, f"{f}/in"))
    return shown(state.read_version(spark, f"{f}/set", v))
