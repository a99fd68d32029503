"""Structured Streaming operators: each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.functions.scoring import ALERT_VITAL_RANGES
from tidemark.operators.events import SPIKE_DELTA, SPIKE_HOURS, open_alerts, vital_alerts
from tidemark.session import shared_folder
from tidemark.sources.versions import Tables

LATENESS = "1 hour"
HOUR_US = 3_600_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of a known frame."""
    reader = spark.readStream.schema(like.schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def open_alert_feed(alerts: DataFrame, ts: str = "created_at", key: str = "alert_id", lateness: str = LATENESS) -> DataFrame:
    """Open alerts, each once, with state kept no longer than the lateness."""
    timed = open_alerts(alerts).withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def vital_anomaly_stream(vitals: DataFrame, ranges: Mapping[str, tuple[float, float]] = ALERT_VITAL_RANGES, entity: str = "patient_id", at: str = "recorded_at") -> DataFrame:
    """Readings outside their range; no state."""
    return vital_alerts(vitals, ranges, entity, at)


def windowed_counts(events: DataFrame, label: str, ts: str, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Rows per tumbling window and label, final once the watermark has passed the window."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, window), label).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), label, "n")
    )


def _with_timers(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """State and event-time timers by key; the state store must be one that holds lists and maps."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Heartbeat(StatefulProcessor):
    """Counts of one label by window; every window that the watermark passes is given, those without rows with 0."""

    def __init__(self, label: str, ts: str, window_us: int):
        self.label, self.ts, self.window = label, ts, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start long", "n long")
        self.next = handle.getValueState("next", "start long")

    def _closed(self, key: tuple, watermark_ms: int) -> Iterator[pd.DataFrame]:
        start, found = self.next.get()[0], []
        while start + self.window <= watermark_ms * 1000:
            n = 0
            if self.counts.containsKey((start,)):
                n = self.counts.getValue((start,))[0]
                self.counts.removeKey((start,))
            found.append((start, start + self.window, key[0], n))
            start += self.window
        if found:
            self.next.update((start,))
            frame = pd.DataFrame(found, columns=["window_start", "window_end", self.label, "n"])
            for name in ("window_start", "window_end"):
                frame[name] = pd.to_datetime(frame[name], unit="us")
            yield frame
        self.handle.registerTimer((start + self.window) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        first = self.next.get()[0] if self.next.exists() else None
        for frame in rows:
            at = frame[self.ts].astype("datetime64[us]").astype("int64")
            start = at[at >= watermark_us] // self.window * self.window
            for window, n in start.value_counts().items():
                known = self.counts.getValue((window,))[0] if self.counts.containsKey((window,)) else 0
                self.counts.updateValue((window,), (known + int(n),))
                first = int(window) if first is None else min(first, int(window))
        if first is not None:
            self.next.update((first,))
            yield from self._closed(key, watermark_us // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._closed(key, timerValues.getCurrentWatermarkInMs())


def heartbeat_counts(events: DataFrame, label: str, ts: str, window_seconds: int = 3600, lateness: str = LATENESS) -> DataFrame:
    """Rows per tumbling window and label, final once the watermark has passed the window, and 0 for every window without
    rows since the label's first: time drives the stream, not its rows."""
    rows = events.select(F.col(label), F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, lateness)
    schema = f"window_start timestamp, window_end timestamp, `{label}` {rows.schema[label].dataType.simpleString()}, n long"
    return _with_timers(rows, label, _Heartbeat(label, ts, window_seconds * 1_000_000), schema)


class _Spikes(StatefulProcessor):
    """Scores of one entity, held until the watermark has passed their hour, and the last score that is final. One timer an entity
    waits for the earliest hour held: every call of the state costs a round trip."""

    def __init__(self, hours: int, delta: float):
        self.within, self.delta = hours * HOUR_US, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, score double")
        self.last = handle.getValueState("last", "at long, score double")

    def _final(self, key: tuple, watermark_ms: int) -> Iterator[pd.DataFrame]:
        until = watermark_ms * 1000 // HOUR_US * HOUR_US
        held = sorted(self.held.get()) if self.held.exists() else []
        final, later = [r for r in held if r[0] < until], [r for r in held if r[0] >= until]
        previous, found = self.last.get() if self.last.exists() else None, []
        for at, score in final:
            if previous and at - previous[0] <= self.within and score - previous[1] >= self.delta:
                found.append((key[0], at, previous[1], score, score - previous[1]))
            previous = (at, score)
        if final:
            self.held.clear()
            if later:
                self.held.put(later)
            self.last.update(previous)
            self.handle.registerTimer((previous[0] + self.within) // 1000 + 1)  # then nothing can be near it
        if later:
            self.handle.registerTimer((later[0][0] // HOUR_US + 1) * HOUR_US // 1000)  # the others get theirs when this one ends
        if found:
            frame = pd.DataFrame(found, columns=["entity", "at", "previous", "score", "delta"])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            yield frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        until = watermark * 1000 // HOUR_US * HOUR_US
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            own = [(int(t), float(x)) for t, x in zip(at, frame["score"]) if t >= until]
            if own:
                self.held.appendList(own)
        yield from self._final(key, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._final(key, watermark)
        if self.last.exists() and not self.held.exists() and self.last.get()[0] + self.within < watermark * 1000:
            self.last.clear()


def score_spike_stream(
    scores: DataFrame, entity: str = "patient_id", at: str = "predicted_at", score: str = "risk_score", hours: int = SPIKE_HOURS, delta: float = SPIKE_DELTA,
    lateness: str = "1 day",
) -> DataFrame:
    """Scores that rose by ``delta`` over the entity's score before within some hours; scores of one time count in ascending order.

    A score is compared once the watermark has passed its hour: then every row that may come before it is known, so rows up to
    ``lateness`` out of order give what the batch rule gives. State holds an entity's rows of that span as a list, and the
    last final score until nothing can be near it. Rows without an entity, time or score are passed over.
    """
    rows = scores.select(F.col(entity).cast("string").alias("entity"), F.col(at).cast("timestamp").alias("at"), F.col(score).cast("double").alias("score"))
    known = rows.dropna().withWatermark("at", lateness)
    return _with_timers(known, "entity", _Spikes(hours, delta), "entity string, at timestamp, previous double, score double, delta double")


def append_features(target: str, key: str, date: str, lateness_days: int = 1) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch by key into the table ``rows`` of the versioned tables at ``target``.

    Rows older than the newest known day less the allowance are passed over. Only months that get a row, or hold a
    replaced one, are rewritten, and only the buckets of the key index that the batch's keys fall into are read. A batch is
    known, with its number, by one pointer written last: a batch that dies changes nothing, one that is repeated is passed
    over.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        tables = Tables(batch.sparkSession, target)
        if tables.note is not None and int(tables.note) >= batch_id:
            return
        tables.merge("rows", batch, key, date, lateness_days)
        tables.publish(str(batch_id))

    return merge


def run_to_end(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process all available input into Parquet below the shared folder and return the written rows."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").option("path", f"{path}/rows")
    writer.outputMode(output_mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
