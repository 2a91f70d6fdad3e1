"""Merging, splitting and selecting speaker turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.numeric import block_of
from callweave.functions.text import is_blank, strip, word_count
from callweave.operators.monoid import carried_maximum, chained, island_parts
from callweave.operators.scans import BLOCK_ROWS

TURN_KEY = ["call_id"]


def _turn_block(rows: int) -> Column:
    return block_of(F.col("seg_idx"), rows)


def drop_blank(turns: DataFrame) -> DataFrame:
    """Turns with text, trimmed, under their original index."""
    return turns.where(~is_blank(F.col("text"))).withColumn("text", strip(F.col("text")))


def empty_transcript_guard(turns: DataFrame) -> DataFrame:
    """One row per call; ``audit_skipped`` says why a call gets no scores."""
    return turns.groupBy("call_id").agg(
        F.when(~F.bool_or(~is_blank(F.col("text"))), "no transcript").alias("audit_skipped")
    )


def merge_adjacent(
    turns: DataFrame, max_gap: float = 0.5, carry: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Merge neighbours of one speaker whose gap to what was merged so far is at most ``max_gap``.

    The end of the merged turn is the largest end seen, so the gap is measured against the running
    maximum inside the speaker's run. ``carry`` columns come from the first turn.
    """
    rows = carried_maximum(turns, TURN_KEY, ["seg_idx"], _turn_block(block_rows), "speaker", "end_time_s", "__end")
    apart = F.col("__end").isNull() | (F.col("start_time_s") - F.col("__end") > max_gap)
    first = ["seg_idx", "speaker", "start_time_s", *carry]
    merged = island_parts(
        rows,
        TURN_KEY,
        ["seg_idx"],
        apart,
        "__island",
        {"__first": F.min_by(F.struct(*first), "seg_idx"), "__end": F.max("end_time_s"), "__n": F.count(F.lit(1))},
        {"__first": F.min_by("__first", "__first.seg_idx"), "end_time_s": F.max("__end"), "n_turns": F.sum("__n")},
    )
    return merged.select(
        "call_id",
        F.col("__first.seg_idx").alias("first_seg"),
        "__first.speaker",
        "__first.start_time_s",
        "end_time_s",
        "n_turns",
        *[f"__first.{c}" for c in carry],
        (F.col("__island") - 1).alias("seg_idx"),
    )


def merge_false_splits(
    turns: DataFrame, threshold: float | None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Merge a turn into the one before when both have one speaker and ``boundary_score`` is low.

    Without a threshold (no boundary model) nothing changes; neither do calls of fewer than three
    turns. The merged end is the last turn's end.
    """
    if threshold is None:
        return turns.select(
            "call_id", "seg_idx", "speaker", "start_time_s", "end_time_s", F.lit(1).cast("long").alias("n_turns")
        )
    block = _turn_block(block_rows)
    sizes = turns.groupBy("call_id").agg(F.count(F.lit(1)).alias("__turns"))
    boundary = (
        F.col("__prev_speaker").isNull()
        | (F.col("__prev_speaker") != F.col("speaker"))
        | (F.col("boundary_score") >= threshold)
        | (F.col("__turns") < 3)
    )
    rows = chained(turns.join(sizes, "call_id"), TURN_KEY, ["seg_idx"], block, {"__prev_speaker": "speaker"}, boundary, "__island")
    return (
        rows.groupBy("call_id", "__island")
        .agg(
            F.min("seg_idx").alias("seg_idx"),
            F.min_by("speaker", "seg_idx").alias("speaker"),
            F.min_by("start_time_s", "seg_idx").alias("start_time_s"),
            F.max_by("end_time_s", "seg_idx").alias("end_time_s"),
            F.count(F.lit(1)).alias("n_turns"),
        )
        .drop("__island")
    )


def split_drifting(
    turns: DataFrame, min_seconds: float = 3.5, drift: float = 0.30
) -> DataFrame:
    """Split a long turn in the middle when its embeddings drift.

    Expects ``d_start_mid``, ``d_mid_end`` and ``d_start_end`` (cosine distances). Adds ``part``.
    """
    start, end = F.col("start_time_s"), F.col("end_time_s")
    middle = (start + end) / 2.0
    split = (
        (end - start >= min_seconds)
        & ((F.col("d_start_mid") > drift) | (F.col("d_mid_end") > drift))
        & (F.col("d_start_end") > drift * 0.7)
    )

    def piece(part: int, a: Column, b: Column, is_split: bool) -> Column:
        return F.struct(
            F.lit(part).cast("long").alias("part"),
            a.alias("a"),
            b.alias("b"),
            F.lit(is_split).alias("is_split"),
        )

    pieces = F.when(
        split, F.array(piece(0, start, middle, True), piece(1, middle, end, True))
    ).otherwise(F.array(piece(0, start, end, False)))
    rest = [c for c in turns.columns if c not in ("start_time_s", "end_time_s", "duration_s")]
    return (
        turns.withColumn("__p", F.explode(pieces))
        .select(
            *rest,
            "__p.part",
            F.col("__p.a").alias("start_time_s"),
            F.col("__p.b").alias("end_time_s"),
            "__p.is_split",
        )
        .withColumn("duration_s", F.round(F.col("end_time_s") - F.col("start_time_s"), 6))
    )


def best_change_point(candidates: DataFrame, keys: Sequence[str], drift: float = 0.30) -> DataFrame:
    """Time of the largest drift per turn; the earliest candidate wins a tie.

    ``candidates`` has ``at_s``, ``drift`` and ``lone``; a lone midpoint (short turn) counts only
    above ``drift``.
    """
    best = candidates.groupBy(*keys).agg(
        F.max(F.struct("drift", (-F.col("at_s")).alias("neg"), "lone")).alias("b")
    )
    keep = ~F.col("b.lone") | (F.col("b.drift") > drift)
    return best.select(*keys, F.when(keep, -F.col("b.neg")).alias("at_s"), F.col("b.drift").alias("drift"))


def collapse_single_speaker(turns: DataFrame, flags: DataFrame) -> DataFrame:
    """Calls flagged ``is_single`` become one turn of spk_0; the others stay."""
    marked = turns.join(flags.select("call_id", "is_single"), "call_id", "left")
    single = F.coalesce("is_single", F.lit(False))
    cols = ["call_id", "seg_idx", "speaker", "start_time_s", "end_time_s"]
    one = (
        marked.where(single)
        .groupBy("call_id")
        .agg(
            F.min("seg_idx").alias("seg_idx"),
            F.min_by("start_time_s", "seg_idx").alias("start_time_s"),
            F.max_by("end_time_s", "seg_idx").alias("end_time_s"),
        )
        .withColumn("speaker", F.lit("spk_0"))
    )
    return marked.where(~single).select(cols).unionByName(one.select(cols))


def turn_boundaries(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, pause: Column, speaker: str
) -> DataFrame:
    """Number turns: a new one starts at a speaker change or where ``pause`` holds.

    ``pause`` may use ``prev_at`` (the previous row's first order column).
    """
    starts = F.col("prev_at").isNull() | (F.col("__prev_speaker") != F.col(speaker)) | pause
    return chained(df, keys, order, block, {"prev_at": order[0], "__prev_speaker": speaker}, starts, "turn_no").drop("__prev_speaker")


def speaker_override(turns: DataFrame) -> DataFrame:
    """Take ``emb_speaker`` for split turns and for disagreeing turns in low-separability regions."""
    take = F.col("is_split") | (F.col("in_low") & (F.col("speaker") != F.col("emb_speaker")))
    return turns.withColumn("final_speaker", F.when(take, F.col("emb_speaker")).otherwise(F.col("speaker")))


def meaningful(turns: DataFrame, min_words: int = 2) -> DataFrame:
    return turns.where(word_count(F.col("text")) >= min_words)
