"""Windowed stage latency, conversational sessions, stage durations and duplicate-free ingest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from callweave.functions.numeric import steady
from callweave.operators.scans import previous

WATERMARK = "10 minutes"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stage_latency(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Latency and failures per stage and event-time window; works on tables and streams.

    ``events`` has (stage_id, status, time_s, event_time).
    """
    if events.isStreaming:
        events = events.withWatermark("event_time", WATERMARK)
    win = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    out = events.groupBy(win, "stage_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("status") == "error").alias("n_failed"),
        F.avg("time_s").alias("mean_s"),
        F.max("time_s").alias("max_s"),
        F.percentile_approx("time_s", 0.99, 10_000).alias("p99_s"),
    )
    return out.select(
        F.col("window.start").alias("window_start"),
        "stage_id",
        "n_events",
        "n_failed",
        steady(F.col("mean_s"), 4).alias("mean_s"),
        "max_s",
        "p99_s",
    )


def sessions(events: DataFrame, key: str, gap: str = "2 seconds") -> DataFrame:
    """Stretches of activity per key that a pause longer than ``gap`` closes."""
    if events.isStreaming:
        events = events.withWatermark("event_time", WATERMARK)
    out = events.groupBy(F.session_window("event_time", gap), key).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("event_time").alias("last_event")
    )
    return out.select(key, F.col("session_window.start").alias("first_event"), "last_event", "n_events")


def stage_durations(events: DataFrame) -> DataFrame:
    """Pair each ``done`` with the ``running`` right before it in the same stage of the same file."""
    rows = events.where(F.col("status").isin("running", "done"))
    rows = previous(
        rows,
        ["filename", "stage_id"],
        ["event_time", "seq"],
        F.date_trunc("day", "event_time"),
        {"started_at": "event_time", "__before": "status"},
    )
    rows = rows.where((F.col("status") == "done") & (F.col("__before") == "running"))
    seconds = (F.unix_micros("event_time") - F.unix_micros("started_at")) / 1e6
    return rows.select("filename", "stage_id", "seq", "started_at", "event_time", steady(seconds, 6).alias("elapsed_s"))


DURATION = "filename string, stage_id string, seq long, began long, ended long"


def pair_events(last: tuple | None, rows: Iterable) -> tuple[tuple | None, list[tuple]]:
    """Pair every ``done`` of a chunk with the ``running`` right before it; ``last`` is what came before the chunk.

    Rows have (status, at, seq). Returns the chunk's last event as (status, at) and the pairs as (seq, began, ended).
    """
    events = sorted((r.at, r.seq, r.status) for r in rows if r.status in ("running", "done"))
    pairs = []
    for when, seq, status in events:
        if status == "done" and last is not None and last[0] == "running":
            pairs.append((seq, last[1], when))
        last = (status, when)
    return last, pairs


def stage_durations_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: the last event of each (filename, stage_id) is the state, whatever time passes until the next.

    Events of a key are put in order within a micro-batch; an event that arrives in a later one counts as later. A micro-batch has few
    events for a stage of a job, so they are handled as rows: a data frame for each would cost more than the work.
    Needs the RocksDB state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Durations(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._last = handle.getValueState("last", "status string, at long")

        def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
            before = self._last.get()
            before = None if before is None else tuple(before)
            last, pairs = pair_events(before, rows)
            if last != before:
                self._last.update(last)
            for seq, began, ended in pairs:
                yield Row(filename=key[0], stage_id=key[1], seq=seq, began=began, ended=ended)

        def close(self) -> None:
            pass

    needed = events.where(F.col("status").isin("running", "done")).select(
        "filename", "stage_id", "status", F.unix_micros("event_time").alias("at"), "seq"
    )
    pairs = needed.groupBy("filename", "stage_id").transformWithState(
        Durations(), outputStructType=DURATION, outputMode="append", timeMode="none"
    )
    return pairs.select(
        "filename",
        "stage_id",
        "seq",
        F.timestamp_micros("began").alias("started_at"),
        F.timestamp_micros("ended").alias("event_time"),
        ((F.col("ended") - F.col("began")) / 1e6).alias("elapsed_s"),
    )


def new_calls(arrivals: DataFrame, known: DataFrame | None = None, key: str = "content_sha1") -> DataFrame:
    """Each content of a batch once, unless ``known`` (what has been processed, however long ago) has it."""
    fresh = arrivals.dropDuplicates([key])
    return fresh if known is None else fresh.join(known.select(key), key, "left_anti")


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
