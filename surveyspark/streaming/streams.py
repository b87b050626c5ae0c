"""The stateful parts of a survey as Structured Streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import state as ST

C = F.col


def read_frames(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """Files as they land."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", pattern) if pattern else r).parquet(path)


def read_listing(spark: SparkSession, root: str, pattern: str = "MAX_*.JPG", files_per_trigger: int = 1000) -> DataFrame:
    """New image files as (path, modificationTime, length)."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    r = r.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return r.load(root).select("path", "modificationTime", "length")


def run_to_parquet(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain what is available into parquet; offsets and state live in the same shared folder."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@contextmanager
def keyed_state(spark: SparkSession):
    """State with timers and maps lives in RocksDB; the session's own choice returns afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


class Marks:
    """A stream of a table's rows that can be closed: it also listens to a folder of closing marks.

    When everything has arrived, one mark far ahead of the last event moves the watermark past all that waits for it.
    The mark's own row waits for a time that never comes, so it leaves no row.
    """

    def __init__(self, rows: DataFrame, folder: str, time: str):
        spark, self.folder, self.schema, self.time = rows.sparkSession, folder, rows.schema, time
        spark.createDataFrame([], rows.schema).write.parquet(f"{folder}/none")
        self.spark = spark
        self.stream = rows.unionByName(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder))

    def close(self) -> None:
        far = F.to_timestamp(F.lit("2200-01-01 00:00:00"))
        row = [far.alias(f.name) if f.name == self.time else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.parquet(f"{self.folder}/end")


def drain(build: Callable[..., DataFrame], inputs: DataFrame | list[DataFrame], folder: str, time: str = "ts") -> DataFrame:
    """``build(*inputs)`` drained into parquet, then closed: what was still open or held at the end is delivered too."""
    inputs = inputs if isinstance(inputs, list) else [inputs]
    marks = [Marks(d, f"{folder}/marks{i}", time) for i, d in enumerate(inputs)]
    stream = build(*[m.stream for m in marks])
    run_to_parquet(stream, folder)
    for m in marks:
        m.close()
    return run_to_parquet(stream, folder)


def hourly_rate(frames: DataFrame, width: str = "30 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Captures and detections per event-time window; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = frames.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("captures"), F.sum(C("detected").cast("int")).alias("detections"))
    return d.select(C("window.start").alias("start"), C("window.end").alias("end"), "captures", "detections")


def sessions(frames: DataFrame, gap: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """A flight as a session of captures without a longer pause."""
    d = frames.withWatermark("ts", late).groupBy("flight", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("captures"))
    return d.select("flight", C("w.start").alias("start"), C("w.end").alias("end"), "captures")


def skip_processed(frames: DataFrame, key: str = "frame", late: str = "1 hour") -> DataFrame:
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


class InOrder(StatefulProcessor):
    """Runs ``step(history, frame row) -> (history, values)`` over a directory's frames in the order of their numbers,
    however they arrive.

    Cameras number frames one after the other, ``stride`` apart. A frame is stepped once the one before it has been;
    one whose predecessor is missing waits in a map until the watermark passes its own time, when all earlier ones are
    in or lost. The map thus holds at most what the watermark's delay spans. Frames later than the watermark are
    dropped by Spark, as in every event-time operator.
    """

    def __init__(self, step: Callable, fields: list[str], columns: list[str], stride: int):
        self.step, self.fields, self.columns, self.stride = step, fields, columns, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "frame bigint", "ms bigint, row string")
        self.done = handle.getValueState("done", "frame bigint, history string")

    def _release(self, key: tuple, waiting: dict[int, tuple[int, str]], watermark: int) -> Iterator[pd.DataFrame]:
        last, history = (lambda x: (x[0], json.loads(x[1])))(self.done.get()) if self.done.exists() else (None, [])
        rows = []
        for frame in sorted(waiting):
            ms, row = waiting[frame]
            follows = frame < self.stride if last is None else frame <= last + self.stride
            if not follows and ms > watermark:
                break
            history, values = self.step(history, json.loads(row))
            rows.append((*key, frame, *values))
            last = frame
            if self.held.containsKey((frame,)):
                self.held.removeKey((frame,))
        if rows:
            self.done.update((last, json.dumps(history)))
            yield pd.DataFrame(rows, columns=["media", "frame", *self.fields])

    def _held(self) -> dict[int, tuple[int, str]]:
        return {int(k[0]): (int(v[0]), v[1]) for k, v in self.held.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, new = self._held(), {}
        for pdf in rows:
            for r in pdf.dropna(subset=["frame"]).itertuples(index=False):
                row = {c: np.asarray(getattr(r, c)).tolist() for c in self.columns}
                new[int(r.frame)] = (int(r.ts.value // 1_000_000), json.dumps(row))
        yield from self._release(key, waiting | new, timerValues.getCurrentWatermarkInMs())
        left = new.keys() - {f for f in new if self.done.exists() and f <= self.done.get()[0]}
        for frame in sorted(left):
            self.held.updateValue((frame,), new[frame])
            self.handle.registerTimer(new[frame][0] + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _in_order(frames: DataFrame, step: Callable, fields: dict[str, str], columns: list[str], stride: int, late: str) -> DataFrame:
    kind = frames.schema["media"].dataType.simpleString()
    out = f"media {kind}, frame bigint, " + ", ".join(f"{n} {k}" for n, k in fields.items())
    grouped = frames.withWatermark("ts", late).groupBy("media")
    return grouped.transformWithStateInPandas(
        statefulProcessor=InOrder(step, list(fields), columns, stride), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def moving_baseline(frames: DataFrame, window: int = 5, stride: int = 1, late: str = "1 hour") -> DataFrame:
    """Pooled median of the last ``window`` frames: frames(media, frame, ts, raws, counts), histograms in state."""

    def step(history, r):
        history = [*history, [r["raws"], r["counts"]]][-window:]
        v = np.concatenate([np.asarray(h[0]) for h in history])
        n = np.concatenate([np.asarray(h[1]) for h in history])
        order = np.argsort(v, kind="stable")
        v, cum = v[order], np.cumsum(n[order])
        at = (cum[-1] - 1) / 2
        lo, hi = v[np.searchsorted(cum, int(np.floor(at)), "right")], v[np.searchsorted(cum, int(np.ceil(at)), "right")]
        return history, (float(lo + hi) / 2 / 10 - 273.15,)

    return _in_order(frames, step, {"baseline": "double"}, ["raws", "counts"], stride, late)


def glint_history(frames: DataFrame, jump: float = 2.0, keep: int = 5, stride: int = 1, late: str = "1 hour") -> DataFrame:
    """Jump from the previous median and deviation from up to four earlier ones: frames(media, frame, ts, median)."""

    def step(history, r):
        m = float(r["median"])
        past = history[-(keep - 1):]
        j = abs(m - past[-1]) if past else None
        dev = abs(m - sum(past) / len(past)) if len(past) >= 2 else None
        flag = (j is not None and j > jump) or (dev is not None and dev > jump * 1.5)
        return [*past, m], (j, dev, bool(flag))

    return _in_order(frames, step, {"temp_jump": "double", "deviation": "double", "has_discontinuity": "boolean"}, ["median"], stride, late)


def released(rows: DataFrame, late: str, every: str = "1 hour", time: str = "ts") -> DataFrame:
    """The rows again, held until the watermark has passed their hour, so that later batches hold only later hours.

    An append-mode window over event time: state holds what the watermark's delay spans, dealt over many keys.
    """
    bucket = F.pmod(F.xxhash64(*rows.columns), F.lit(64)).alias("_b")
    held = rows.withWatermark(time, late).groupBy(F.window(time, every), bucket).agg(F.collect_list(F.struct(*rows.columns)).alias("_r"))
    return held.select(F.inline("_r"))


def paired_frames(rgb: DataFrame, infrared: DataFrame, within: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(media, frame, rgb_path, infrared_path): frames whose two files have landed, and those whose other file has not
    come by the time the watermark rules it out. Each side has media, frame, ts and path."""
    a = rgb.withWatermark("ts", late).select("media", "frame", C("ts").alias("a_ts"), C("path").alias("rgb_path"))
    b = infrared.withWatermark("ts", late).select(C("media").alias("b_media"), C("frame").alias("b_frame"), C("ts").alias("b_ts"), C("path").alias("infrared_path"))
    same = (C("media") == C("b_media")) & (C("frame") == C("b_frame"))
    near = C("a_ts").between(C("b_ts") - F.expr(f"interval {within}"), C("b_ts") + F.expr(f"interval {within}"))
    j = a.join(b, same & near, "full_outer")
    # Rows without a frame go last: Spark would move the test below the watermark, which then missed their time.
    return j.select(F.coalesce("media", "b_media").alias("media"), F.coalesce("frame", "b_frame").alias("frame"), "rgb_path", "infrared_path").filter("frame is not null")


def dedup_locations(detections: DataFrame, folder: str, radius_m: float, late: str = "1 hour") -> int:
    """Fold arriving detections(ord, frame, ts, lat, lon, area_m2) into the persisted location set; returns the last version.

    Detections are held until all earlier ones are in, so the set is the same however files arrive. Each batch writes
    its own version from the one before it, so a batch repeated after a failure overwrites exactly what it wrote the
    first time. The stream is closed at its end: nothing stays held.
    """
    spark = detections.sparkSession
    empty = spark.createDataFrame(
        [], "location bigint, lat double, lon double, first_frame bigint, last_frame bigint, detection_count bigint, area_m2 double, geometry_frame bigint"
    )
    ST.write_version(empty, folder, 0)
    last = [0]

    def confirm(batch: DataFrame, batch_id: int) -> None:
        old = ST.read_version(spark, folder, batch_id)
        new = batch.filter("ord is not null").drop("ts")
        ST.write_version(old if new.isEmpty() else ST.upsert(old, new, radius_m), folder, batch_id + 1)
        last[0] = batch_id + 1

    marks = Marks(detections, f"{folder}_marks", "ts")
    ready = released(marks.stream, late)
    for closing in (False, True):
        if closing:
            marks.close()
        q = ready.writeStream.foreachBatch(confirm).option("checkpointLocation", f"{folder}_offsets").trigger(availableNow=True).start()
        q.awaitTermination()
    return last[0]
