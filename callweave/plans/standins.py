"""Views that give the test tables the shape of calls, words, frames, embeddings and stage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.lexicon import JOB_STAGES
from callweave.functions.numeric import block_of
from callweave.operators.scans import Run, numbered, running
from callweave.session import dealt

WORD_S = 0.4
WS = r"\s+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations, timed by their word counts; turns follow each other without a gap."""
    role = F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "customer").otherwise("overlap")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("seg_idx"),
        role.alias("speaker"),
        "text",
        F.size(F.split("text", WS)).cast("long").alias("nw"),
    )
    rows = running(
        rows, ["call_id"], ["seg_idx"], block_of(F.col("seg_idx"), 65_536), {"__cw": Run("sum", F.col("nw"))}
    )
    return rows.select(
        "call_id",
        "seg_idx",
        "speaker",
        "text",
        "nw",
        F.round(WORD_S * (F.col("__cw") - F.col("nw")), 3).alias("start_time_s"),
        F.round(WORD_S * F.col("__cw"), 3).alias("end_time_s"),
        F.round(WORD_S * F.col("nw"), 3).alias("duration_s"),
    )


def diarized(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as a diarizer sees them: spk_0 / spk_1, with pauses and some overlapping ends."""
    size = F.length("text")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("seg_idx"),
        F.when(F.col("role") == "system", "overlap").otherwise(F.concat(F.lit("spk_"), size % 2)).alias("speaker"),
        "text",
        F.size(F.split("text", WS)).cast("long").alias("nw"),
        (size % 4).cast("long").alias("pause"),
        F.when(size % 5 == 0, 2.0).otherwise(0.0).alias("extra"),
    )
    rows = running(
        rows,
        ["call_id"],
        ["seg_idx"],
        block_of(F.col("seg_idx"), 65_536),
        {"__cw": Run("sum", F.col("nw")), "__cp": Run("sum", F.col("pause"))},
    )
    start = F.round(WORD_S * (F.col("__cw") - F.col("nw")) + 0.3 * F.col("__cp"), 3)
    out = rows.withColumn("start_time_s", start).withColumn(
        "end_time_s", F.round(F.col("start_time_s") + WORD_S * F.col("nw") + F.col("extra"), 3)
    )
    return out.select(
        "call_id",
        "seg_idx",
        "speaker",
        "text",
        "nw",
        "start_time_s",
        "end_time_s",
        F.round(F.col("end_time_s") - F.col("start_time_s"), 3).alias("duration_s"),
    )


def words(spark: SparkSession, folder: str) -> DataFrame:
    """One row per word, with times that jitter across turn borders."""
    seg = segments(spark, folder)
    rows = seg.select("call_id", "seg_idx", "start_time_s", F.posexplode(F.split("text", WS)).alias("pos", "text"))
    start = F.round(F.col("start_time_s") + WORD_S * F.col("pos") + (F.length("text") % 5 - 2) * 0.15, 3)
    return rows.select(
        "call_id",
        (F.col("seg_idx") * 1_000_000 + F.col("pos")).alias("word_idx"),
        start.alias("start"),
        F.round(start + WORD_S, 3).alias("end"),
        "text",
        ((F.length("text") * 7 % 50 + 50) / 100.0).alias("probability"),
    )


def emotions(seg: DataFrame) -> DataFrame:
    """Surrogate text and acoustic predictions from text lengths."""
    labels = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
    names = F.array(*[F.lit(x) for x in labels])
    tones = F.array(*[F.lit(x) for x in ("anger", "sad", "joy", "fear", "neutral", "disgusted", "surprised", "annoyed")])
    n = F.length("text")
    return seg.withColumns(
        {
            "label": F.get(names, (n % 7).cast("int")),
            "confidence": (n % 100) / 100.0,
            "tone": F.get(tones, (n * 3 % 8).cast("int")),
            "tone_confidence": (n * 37 % 100) / 100.0,
            "tone_indeterminate": n % 3 == 0,
        }
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document as a call of one turn; even documents are spoken by the agent."""
    docs = dealt(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("call_id"),
        F.lit(0).cast("long").alias("seg_idx"),
        F.when(F.col("doc_id") % 2 == 0, "agent").otherwise("customer").alias("speaker"),
        "text",
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty vectors form a call; the label's parity is the speaker."""
    v = F.col("vec_id")
    seg = v % 50
    start = F.round(seg * 1.5, 3)
    return table(spark, folder, "embeddings").select(
        F.floor(v / 50).alias("call_id"),
        seg.alias("seg_idx"),
        F.concat(F.lit("spk_"), F.col("label") % 2).alias("speaker"),
        F.col("label").cast("long").alias("label"),
        start.alias("start_time_s"),
        F.round(start + 1.0 + F.col("label") * 0.2, 3).alias("end_time_s"),
        F.round(F.lit(1.0) + F.col("label") * 0.2, 3).alias("duration_s"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def chunk_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as a chunk of three slots of 22 elements; neighbours share one, so all 64 are read."""
    emb = embeddings(spark, folder)
    slots = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("embedding", i * 21 + 1, 22))
    return emb.select("call_id", F.col("seg_idx").alias("chunk_idx"), F.posexplode(slots).alias("class_idx", "embedding"))


def activations(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as 22 frames of three class activations; the last one ends with the vector."""
    emb = embeddings(spark, folder)
    frames = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.slice("embedding", F.least(i * 3 + 1, F.lit(62)), 3))
    return emb.select("call_id", F.col("seg_idx").alias("chunk_idx"), F.posexplode(frames).alias("frame_idx", "probs"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user in time order as frames; errors play unvoiced frames."""
    ev = table(spark, folder, "events").select(
        F.col("user_id").alias("call_id"), "ts", "event_id", "event_type", "value"
    )
    rows = numbered(ev, ["call_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "frame_idx")
    quiet = (F.col("frame_idx") % 20 < 6) & (F.col("call_id") % 3 != 0)
    return rows.select(
        "call_id",
        "frame_idx",
        "event_id",
        "event_type",
        "value",
        F.floor(F.col("frame_idx") / 20).alias("seg_idx"),
        F.when(quiet, 1e-6).otherwise(F.col("value") * F.col("value")).alias("energy"),
        (F.col("value") / 100.0).alias("rms"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(80.0 + F.col("value")).alias("pitch_hz"),
        (F.col("value") * 7 % 50).alias("zcr"),
        F.col("value").alias("level"),
    )


def blocks(frame_rows: DataFrame, value: str, block_samples: int) -> DataFrame:
    """Frames' values as sample blocks."""
    entry = F.struct("frame_idx", F.col(value).cast("double").alias("x"))
    return (
        frame_rows.withColumn("block_idx", block_of(F.col("frame_idx"), block_samples))
        .groupBy("call_id", "block_idx")
        .agg(F.array_sort(F.collect_list(entry)).alias("__b"))
        .select("call_id", "block_idx", F.transform("__b", lambda b: b["x"]).alias("samples"))
    )


def vector_blocks(spark: SparkSession, folder: str, vectors_per_block: int = 25) -> DataFrame:
    """The vectors of a call one after the other as a waveform."""
    emb = embeddings(spark, folder)
    entry = F.struct("seg_idx", "embedding")
    return (
        emb.withColumn("block_idx", block_of(F.col("seg_idx"), vectors_per_block))
        .groupBy("call_id", "block_idx")
        .agg(F.array_sort(F.collect_list(entry)).alias("__b"))
        .select("call_id", "block_idx", F.flatten(F.transform("__b", lambda b: b["embedding"])).alias("samples"))
    )


def stage_events(ev: DataFrame) -> DataFrame:
    """Events as stage events of one job per user."""
    stages = F.array(*[F.lit(s) for s in JOB_STAGES])
    kind = (
        F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 5 == 0, "created").otherwise("done"))
        .when(F.col("event_type") == "view", "running")
        .when(F.col("event_type") == "click", "done")
        .when(F.col("event_type") == "error", F.when(F.col("event_id") % 4 == 0, "failed").otherwise("error"))
        .otherwise(F.when(F.col("event_id") % 3 == 0, "finished").otherwise("running"))
    )
    return ev.select(
        F.col("user_id").cast("string").alias("filename"),
        F.get(stages, (F.col("event_id") % 9).cast("int")).alias("stage_id"),
        kind.alias("status"),
        F.col("value").alias("time_s"),
        F.when(kind == "failed", F.concat(F.lit("E"), F.col("event_id"))).alias("error"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_id").alias("seq"),
    )
