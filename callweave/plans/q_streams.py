"""Queries over stage events, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import rules
from callweave.functions.lexicon import JOB_STAGES
from callweave.functions.numeric import steady
from callweave.plans import standins
from callweave.plans.oracle import EVT, rnd
from callweave.plans.registry import query
from callweave.session import scratch_folder
from callweave.sources.store import read_results
from callweave.streaming import metrics, progress, sinks


def arriving(spark, d, name):
    """A table as a file stream, be it one file or a folder of files.

    The glob stands for exactly that name; a plain path would have to be a folder.
    """
    return spark.readStream.schema(standins.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def event_stream(spark, d):
    return arriving(spark, d, "events")


PROGRESS = f"""{EVT}, cr AS (SELECT filename, max((event_time, seq)) AS c FROM evt WHERE status = 'created' GROUP BY filename),
lv AS (SELECT e.* FROM evt e JOIN cr ON e.filename = cr.filename WHERE (e.event_time, e.seq) >= cr.c),
sg AS (SELECT filename, stage_id, arg_max(status, (event_time, seq)) AS s, arg_max(time_s, (event_time, seq)) FILTER (status = 'done') AS t
  FROM lv WHERE status IN ('running', 'done', 'error') GROUP BY filename, stage_id),
dn AS (SELECT filename, count(*) FILTER (s = 'done') AS n_done, string_agg(stage_id || ':' || s || ':' || coalesce(t, 0.0), ',' ORDER BY stage_id || ':' || s || ':' || coalesce(t, 0.0)) AS stages FROM sg GROUP BY filename),
fs AS (SELECT filename, arg_max(status, (event_time, seq)) FILTER (status IN ('created', 'running', 'finished', 'failed')) AS s,
  arg_max(status, (event_time, seq)) FILTER (status IN ('created', 'running', 'done', 'error', 'finished')) AS p,
  arg_max(stage_id, (event_time, seq)) FILTER (status IN ('running', 'done', 'error')) AS current_stage,
  arg_max(coalesce(error, ''), (event_time, seq)) FILTER (status IN ('created', 'running', 'finished', 'failed')) AS e, arg_max(time_s, (event_time, seq)) FILTER (status IN ('created', 'running', 'finished', 'failed')) AS ts FROM lv GROUP BY filename),
pg AS (SELECT f.filename, CASE s WHEN 'created' THEN 'queued' WHEN 'running' THEN 'running' WHEN 'finished' THEN 'completed' ELSE 'error' END AS status,
  coalesce(current_stage, '') AS current_stage, (CASE WHEN p = 'finished' THEN 100 ELSE round(coalesce(n_done, 0) / {len(JOB_STAGES)} * 100) END)::BIGINT AS percent,
  coalesce(n_done, 0) AS n_done, coalesce(stages, '') AS stages,
  CASE WHEN s = 'failed' THEN e END AS error, CASE WHEN s IN ('finished', 'failed') THEN ts END AS time_s FROM fs f LEFT JOIN dn ON f.filename = dn.filename)"""
COLS = ["filename", "status", "current_stage", "percent", "n_done", "stages", "error", "time_s"]


@query("st1_job_progress", f"WITH {PROGRESS} SELECT * FROM pg")
def st1(spark, d):
    return progress.progress_batch(standins.stage_events(standins.table(spark, d, "events")))


@query("st1_job_progress_stream", f"WITH {PROGRESS} SELECT * FROM pg")
def st1s(spark, d):
    """The same by a stateful stream whose snapshots are upserted per micro-batch."""
    metrics.use_rocksdb(spark)
    base = scratch_folder(spark, "progress")
    snaps = progress.progress_stream(standins.stage_events(event_stream(spark, d)))
    sinks.upsert_stream(snaps, base + "/table", base + "/ckpt", ["filename"], ["as_of", "as_of_seq"]).awaitTermination()
    return read_results(spark, base + "/table").select(COLS)


@query("st3_terminal_jobs", f"WITH {PROGRESS} SELECT filename, status, percent FROM pg WHERE status IN ('completed', 'error')")
def st3(spark, d):
    out = progress.progress_batch(standins.stage_events(standins.table(spark, d, "events")))
    return progress.terminal(out).select("filename", "status", "percent")


LATENCY = f"""{EVT}, lt AS (SELECT date_trunc('hour', event_time) AS w, stage_id, count(*) AS n_events, count(*) FILTER (status = 'error') AS n_failed,
  {rnd("avg(time_s)", 4)} AS mean_s, max(time_s) AS max_s FROM evt GROUP BY w, stage_id)"""


@query("st4_stage_latency", f"WITH {LATENCY} SELECT epoch_us(w) AS window_us, stage_id, n_events, n_failed, mean_s, max_s FROM lt")
def st4(spark, d):
    out = metrics.stage_latency(standins.stage_events(standins.table(spark, d, "events")))
    return out.select(F.unix_micros("window_start").alias("window_us"), "stage_id", "n_events", "n_failed", "mean_s", "max_s")


@query(
    "st4_stage_latency_sliding",
    f"""WITH {EVT}, w AS (SELECT *, date_trunc('hour', event_time) - to_hours(k::INT) AS w FROM evt, (SELECT unnest(range(0, 6)) AS k))
    SELECT epoch_us(w) AS window_us, stage_id, count(*) AS n_events, count(*) FILTER (status = 'error') AS n_failed, {rnd("avg(time_s)", 4)} AS mean_s, max(time_s) AS max_s
    FROM w GROUP BY w, stage_id""",
)
def st4w(spark, d):
    out = metrics.stage_latency(standins.stage_events(standins.table(spark, d, "events")), "6 hours", "1 hour")
    return out.select(F.unix_micros("window_start").alias("window_us"), "stage_id", "n_events", "n_failed", "mean_s", "max_s")


@query("st4_stage_latency_stream", f"WITH {LATENCY} SELECT epoch_us(w) AS window_us, stage_id, n_events, n_failed, mean_s, max_s FROM lt")
def st4s(spark, d):
    base = scratch_folder(spark, "latency")
    out = metrics.stage_latency(standins.stage_events(event_stream(spark, d)))
    sinks.upsert_stream(out, base + "/table", base + "/ckpt", ["window_start", "stage_id"]).awaitTermination()
    rows = read_results(spark, base + "/table")
    return rows.select(F.unix_micros("window_start").alias("window_us"), "stage_id", "n_events", "n_failed", "mean_s", "max_s")


@query("st5_new_calls_stream", "SELECT DISTINCT sha1(text) AS content_sha1 FROM documents")
def st5(spark, d):
    """Documents arriving as calls over many days; a content that arrives again is not processed again."""
    base = scratch_folder(spark, "ingest")
    arrivals = arriving(spark, d, "documents").select(
        F.sha1("text").alias("content_sha1"), F.timestamp_seconds(F.col("doc_id") % 300 * 86_400 + 1_700_000_000).alias("event_time")
    )
    sinks.append_new_stream(arrivals, base + "/table", base + "/ckpt").awaitTermination()
    return spark.read.parquet(base + "/table").select("content_sha1")


SESSION = f"""{EVT}, ss AS (SELECT *, lag(event_time) OVER (PARTITION BY filename ORDER BY event_time, seq) AS p FROM evt),
sn AS (SELECT *, sum(CASE WHEN p IS NULL OR event_time >= p + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY filename ORDER BY event_time, seq) AS k FROM ss)
SELECT filename, epoch_us(min(event_time)) AS first_us, epoch_us(max(event_time)) AS last_us, count(*) AS n_events FROM sn GROUP BY filename, k"""


def _session_columns(out):
    return out.select("filename", F.unix_micros("first_event").alias("first_us"), F.unix_micros("last_event").alias("last_us"), "n_events")


@query("st7_sessions", f"WITH {SESSION}")
def st7(spark, d):
    return _session_columns(metrics.sessions(standins.stage_events(standins.table(spark, d, "events")), "filename", "6 hours"))


@query("st7_sessions_stream")
def st7s(spark, d):
    """Closed sessions only: the last ones stay open until later events arrive."""
    base = scratch_folder(spark, "sessions")
    out = metrics.sessions(standins.stage_events(event_stream(spark, d)), "filename", "6 hours")
    sinks.append_stream(out, base + "/table", base + "/ckpt").awaitTermination()
    return _session_columns(spark.read.parquet(base + "/table"))


DURATIONS = f"""WITH {EVT}, l AS (SELECT *, lag(status) OVER w AS ps, lag(event_time) OVER w AS pt FROM evt WHERE status IN ('running', 'done')
      WINDOW w AS (PARTITION BY filename, stage_id ORDER BY event_time, seq))
    SELECT filename, stage_id, seq, {rnd("(epoch_us(event_time) - epoch_us(pt)) / 1e6", 6)} AS elapsed_s FROM l WHERE status = 'done' AND ps = 'running'"""


@query("st8_stage_durations", f"{DURATIONS}")
def st8(spark, d):
    out = metrics.stage_durations(standins.stage_events(standins.table(spark, d, "events")))
    return out.select("filename", "stage_id", "seq", "elapsed_s")


@query("st8_stage_durations_stream", f"{DURATIONS}")
def st8s(spark, d):
    """The same by a stream whose state is the last event of each stage."""
    metrics.use_rocksdb(spark)
    base = scratch_folder(spark, "durations")
    out = metrics.stage_durations_stream(standins.stage_events(event_stream(spark, d)))
    sinks.append_stream(out, base + "/table", base + "/ckpt").awaitTermination()
    rows = spark.read.parquet(base + "/table")
    return rows.select("filename", "stage_id", "seq", steady(F.col("elapsed_s"), 6).alias("elapsed_s"))


@query("fx16_percent_done", "SELECT user_id, (round_even(count(*) / 150.0 * 100, 0))::BIGINT AS percent FROM events GROUP BY user_id")
def fx16(spark, d):
    n = standins.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", rules.percent_done(F.col("n"), 150).alias("percent"))
