"""Joins between timed things of one call: words, turns, regions, chunks, seconds.

Every range join carries the call and a coarse time bucket as equality keys, so a very long call is
spread over many tasks and no pair outside a bucket is ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.numeric import block_of, steady
from callweave.functions.vectors import argmax
from callweave.operators.monoid import chained

BUCKET_S = 10.0
PAGE_S = 3600.0


def time_buckets(df: DataFrame, start: Column, end: Column, seconds: float = BUCKET_S, name: str = "__bucket") -> DataFrame:
    """One copy of the row per time bucket the interval touches."""
    first = F.floor(start / F.lit(seconds)).cast("long")
    last = F.floor(F.greatest(start, end) / F.lit(seconds)).cast("long")
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def align_words(words: DataFrame, turns: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """Give each word to the turn it overlaps most; the earlier turn wins a tie.

    Words that overlap no turn are dropped. Both copies of a pair that spans two buckets carry the
    same values, so the maximum needs no de-duplication.
    """
    w = time_buckets(words, F.col("start"), F.col("end"), bucket_s)
    t = time_buckets(
        turns.select(
            "call_id", "seg_idx", F.col("start_time_s").alias("__s"), F.col("end_time_s").alias("__e")
        ),
        F.col("__s"),
        F.col("__e"),
        bucket_s,
    )
    overlap = F.least("end", "__e") - F.greatest("start", "__s")
    best = (
        w.join(t, ["call_id", "__bucket"])
        .where(overlap > 0)
        .groupBy("call_id", "word_idx")
        .agg(
            F.max(
                F.struct(
                    overlap.alias("overlap"),
                    (-F.col("seg_idx")).alias("neg_idx"),
                    F.col("__s").alias("turn_start"),
                    "start",
                    "end",
                    "text",
                    "probability",
                )
            ).alias("b")
        )
    )
    return best.select(
        "call_id",
        "word_idx",
        (-F.col("b.neg_idx")).alias("seg_idx"),
        "b.overlap",
        "b.turn_start",
        "b.start",
        "b.end",
        "b.text",
        "b.probability",
    )


def turn_transcripts(aligned: DataFrame, turns: DataFrame, page_s: float = PAGE_S) -> DataFrame:
    """Turns with their words and text; turns without words stay, with empty text.

    A turn's words are gathered in pages of at most ``page_s`` seconds, so no row grows with the
    length of a recording. A turn shorter than that is one row, page 0.
    """
    page = F.floor(F.greatest(F.col("start") - F.col("turn_start"), F.lit(0.0)) / F.lit(page_s)).cast("long")
    entry = F.struct(
        "word_idx",
        F.round("start", 3).alias("start"),
        F.round("end", 3).alias("end"),
        F.col("text").alias("word"),
        "probability",
    )
    pages = (
        aligned.withColumn("page", page)
        .groupBy("call_id", "seg_idx", "page")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("__w"),
            F.count(F.lit(1)).alias("__n"),
            F.sum("probability").alias("__p"),
        )
    )
    turn = Window.partitionBy("call_id", "seg_idx")
    pages = pages.select(
        "call_id",
        "seg_idx",
        "page",
        F.transform(
            "__w",
            lambda w: F.struct(
                w["start"].alias("start"),
                w["end"].alias("end"),
                w["word"].alias("word"),
                w["probability"].alias("probability"),
            ),
        ).alias("words"),
        F.trim(F.array_join(F.transform("__w", lambda w: w["word"]), " ")).alias("text"),
        F.sum("__n").over(turn).alias("n_words"),
        steady(F.sum("__p").over(turn) / F.sum("__n").over(turn), 3).alias("avg_logprob"),
    )
    base = turns.drop("text", "words", "avg_logprob", "n_words")
    out = base.join(pages, ["call_id", "seg_idx"], "left")
    empty = F.array().cast(pages.schema["words"].dataType)
    return out.withColumns(
        {
            "page": F.coalesce("page", F.lit(0).cast("long")),
            "duration_s": F.round(F.col("end_time_s") - F.col("start_time_s"), 6),
            "words": F.coalesce("words", empty),
            "text": F.coalesce("text", F.lit("")),
            "n_words": F.coalesce("n_words", F.lit(0).cast("long")),
            "avg_logprob": F.coalesce("avg_logprob", F.lit(0.0)),
        }
    )


def points_in_regions(
    points: DataFrame, regions: DataFrame, at: str, closed: bool = True, bucket_s: float = BUCKET_S
) -> DataFrame:
    """Points that lie in any region of their call (``start_s``..``end_s``)."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / F.lit(bucket_s)).cast("long"))
    r = time_buckets(
        regions.select(
            F.col("call_id").alias("__call"), F.col("start_s").alias("__s"), F.col("end_s").alias("__e")
        ),
        F.col("__s"),
        F.col("__e"),
        bucket_s,
        "__cell",
    )
    upper = F.col(at) <= F.col("__e") if closed else F.col(at) < F.col("__e")
    hit = (
        (F.col("call_id") == F.col("__call"))
        & (F.col("__bucket") == F.col("__cell"))
        & (F.col(at) >= F.col("__s"))
        & upper
    )
    return p.join(r, hit, "left_semi").drop("__bucket")


def active_turns(playheads: DataFrame, turns: DataFrame, at: str, bucket_s: float = BUCKET_S) -> DataFrame:
    """Every (playhead, turn) pair with start <= at < end."""
    p = playheads.withColumn("__bucket", F.floor(F.col(at) / F.lit(bucket_s)).cast("long"))
    t = time_buckets(
        turns.select("call_id", "seg_idx", "start_time_s", "end_time_s"),
        F.col("start_time_s"),
        F.col("end_time_s"),
        bucket_s,
    )
    pairs = p.join(t, ["call_id", "__bucket"]).drop("__bucket")
    return pairs.where((F.col("start_time_s") <= F.col(at)) & (F.col(at) < F.col("end_time_s")))


def nearest_chunk(
    turns: DataFrame,
    grid: DataFrame,
    activations: DataFrame | None = None,
    frames: int | None = None,
) -> DataFrame:
    """Chunk (and frame, and most active class) at each turn's centre.

    ``grid`` has one row per call: ``chunk_start``, ``chunk_step``, ``chunk_duration``,
    ``n_chunks``. The grid is regular, so the chunk is a computed key and the join is an equi join.
    """
    centre = (F.col("start_time_s") + F.col("end_time_s")) / 2.0
    out = turns.join(grid, "call_id").withColumn("centre_s", centre)
    raw = F.bround((F.col("centre_s") - F.col("chunk_start")) / F.col("chunk_step"), 0).cast("long")
    out = out.withColumn(
        "chunk_idx", F.greatest(F.lit(0), F.least(raw, F.col("n_chunks") - 1)).cast("long")
    )
    if frames is not None:
        rel = F.col("centre_s") - (F.col("chunk_start") + F.col("chunk_idx") * F.col("chunk_step"))
        frame = (rel / F.col("chunk_duration") * F.lit(frames)).cast("long")
        out = out.withColumn(
            "frame_idx", F.greatest(F.lit(0), F.least(frame, F.lit(frames - 1))).cast("long")
        )
    if activations is not None:
        act = activations.select(
            "call_id", "chunk_idx", "frame_idx", argmax(F.col("probs")).cast("long").alias("class_idx")
        )
        out = out.join(act, ["call_id", "chunk_idx", "frame_idx"], "left")
    return out.drop("chunk_start", "chunk_step", "chunk_duration", "n_chunks")


def seconds_timeline(turns: DataFrame, horizon: DataFrame | None = None, name: str = "speaker") -> DataFrame:
    """One row per active second of a call; a later turn overwrites an earlier one.

    ``horizon`` (call_id, n_seconds) cuts the timeline at the end of the recording.
    """
    last = F.ceil("end_time_s").cast("long") - 1
    if horizon is not None:
        turns = turns.join(horizon, "call_id")
        last = F.least(last, F.col("n_seconds") - 1)
    first = F.floor("start_time_s").cast("long")
    secs = turns.where(last >= first).withColumn("second", F.explode(F.sequence(first, last)))
    return secs.groupBy("call_id", "second").agg(F.max_by("speaker", "seg_idx").alias(name))


def swept_timeline(
    sides: Mapping[str, DataFrame], horizon: DataFrame | None = None, bucket_s: int = 600, block_s: int = 65_536
) -> DataFrame:
    """Stretches of whole seconds (call_id, start_s, stop_s) and who speaks on each side; null where a side is silent.

    ``sides`` names tables of turns. Every second belongs to the latest turn on it, as in ``seconds_timeline``, but a row is made for each piece
    between two neighbouring turn boundaries, not for each second. Turns meet the pieces below them by call and bucket of ``bucket_s`` seconds.
    """
    rows = None
    for name, turns in sides.items():
        stop = F.ceil("end_time_s").cast("long")
        if horizon is not None:
            turns = turns.join(horizon, "call_id")
            stop = F.least(stop, F.col("n_seconds"))
        part = turns.select(
            "call_id", F.lit(name).alias("side"), "seg_idx", "speaker", F.floor("start_time_s").cast("long").alias("first"), stop.alias("stop")
        ).where("stop > first")
        rows = part if rows is None else rows.unionByName(part)
    edges = rows.select("call_id", F.explode(F.array("first", "stop")).alias("stop_s")).distinct()
    pieces = chained(edges, ["call_id"], ["stop_s"], block_of(F.col("stop_s"), block_s), {"start_s": "stop_s"}, F.lit(False), "__n")
    pieces = pieces.where("start_s is not null").select("call_id", "start_s", "stop_s", block_of(F.col("start_s"), bucket_s).alias("bucket"))
    buckets = F.sequence(block_of(F.col("first"), bucket_s), block_of(F.col("stop") - 1, bucket_s))
    over = rows.withColumn("bucket", F.explode(buckets))
    met = over.join(pieces, ["call_id", "bucket"]).where("start_s >= first and start_s < stop")
    last = lambda name, c: F.when(F.col("side") == name, F.col(c))
    return met.groupBy("call_id", "start_s", "stop_s").agg(*[F.max_by(last(name, "speaker"), last(name, "seg_idx")).alias(name) for name in sides])
