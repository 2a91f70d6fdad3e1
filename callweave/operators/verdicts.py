"""Turning reviewer answers (JSON text) into violation rows and audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.jsonfix import parse_rows, unfence

VERDICT_ROW = (
    "index long, compliant boolean, violations array<struct<type string, keyword string, context_note string>>"
)
CATEGORIES = ("abusive", "rbi", "irdai")


def parse_verdicts(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """(call_id, seg_idx, violations, compliant) from one answer per call; bad answers give no rows."""
    # A repeated index keeps the last entry.
    numbered = answers.select("call_id", F.posexplode(parse_rows(F.col(raw), VERDICT_ROW)).alias("pos", "v"))
    last = (
        numbered.where(F.col("v.index").isNotNull())
        .groupBy("call_id", F.col("v.index").alias("seg_idx"))
        .agg(F.max_by("v", "pos").alias("v"))
    )
    return last.select("call_id", "seg_idx", "v.violations", "v.compliant")


def verdicts_per_turn(turns: DataFrame, answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Verdict of every turn of an answered call; turns the answer leaves out have no violations."""
    parsed = parse_verdicts(answers, raw)
    none = F.array().cast("array<struct<type:string,keyword:string,context_note:string>>")
    known = F.filter(F.coalesce("violations", none), lambda v: v["type"].isin(*CATEGORIES))
    flags = F.transform(known, lambda v: F.concat(F.upper(v["type"]), F.lit(":"), F.coalesce(v["keyword"], F.lit(""))))
    return (
        turns.select("call_id", "seg_idx", "speaker")
        .join(parsed, ["call_id", "seg_idx"], "left")
        .withColumn("flags", flags)
        .select(
            "call_id",
            "seg_idx",
            "speaker",
            "flags",
            F.size("flags").cast("long").alias("violation_count"),
            F.coalesce("compliant", F.size("flags") == 0).alias("compliant"),
        )
    )


AUDIT_SCHEMA = (
    "compliance struct<segment_results: array<struct<index: long, flags: array<string>, violation_count: long>>>, "
    "qa struct<qa_score: double, grade: string>, crm_note struct<summary: string>"
)


def parse_audit(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Accept a combined answer only when compliance, qa and crm_note are all there."""
    text = unfence(F.col(raw))
    is_object = F.try_parse_json(text).isNotNull() & text.startswith("{")
    keys = F.json_object_keys(text)
    complete = F.array_contains(keys, "compliance") & F.array_contains(keys, "qa") & F.array_contains(keys, "crm_note")
    return answers.withColumn("audit", F.when(is_object & complete, F.from_json(text, AUDIT_SCHEMA)))


def audit_turn_times(audits: DataFrame, turns: DataFrame) -> DataFrame:
    """Segment results of an audit with the times of the turn they name; unknown indices are ignored."""
    rows = audits.select("call_id", F.explode("audit.compliance.segment_results").alias("r")).select(
        "call_id", F.col("r.index").alias("seg_idx"), "r.flags", "r.violation_count"
    )
    return rows.join(turns.select("call_id", "seg_idx", "start_time_s", "end_time_s"), ["call_id", "seg_idx"])
