"""Small business rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.lexicon import (
    EMOTION_SENTIMENT,
    NEGATIVE_DISPLAY,
    QA_GRADES,
    SENTIMENT_BASE,
    TEXT_LABELS,
)
from callweave.functions.numeric import ladder


def _lookup(table: dict, key: Column, otherwise: object) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(otherwise))


def is_agent(speaker: Column) -> Column:
    s = F.lower(speaker)
    return s.contains("agent") | (s == "spk_0")


def is_customer(speaker: Column) -> Column:
    s = F.lower(speaker)
    return s.contains("customer") | (s == "spk_1")


def duration_confidence(seconds: Column) -> Column:
    return ladder(seconds, [(2.0, 1.0), (1.0, 0.85), (0.5, 0.65), (0.3, 0.4)], 0.2)


def needs_review(seconds: Column, margin: Column) -> Column:
    """Short turns whose two speakers are about equally likely."""
    return (seconds < 0.5) & (F.abs(F.coalesce(margin, F.lit(0.0))) < 0.1)


def too_short_to_judge(seconds: Column) -> Column:
    return seconds < 0.3


def emotion_of_label(label: Column) -> Column:
    return _lookup({k: v[0] for k, v in TEXT_LABELS.items()}, label, "neutral")


def sentiment_of_label(label: Column) -> Column:
    return _lookup({k: v[1] for k, v in TEXT_LABELS.items()}, label, "neutral")


def sentiment_of_emotion(emotion: Column) -> Column:
    return _lookup(EMOTION_SENTIMENT, emotion, "neutral")


def sentiment_value(sentiment: Column) -> Column:
    return _lookup(SENTIMENT_BASE, F.lower(F.coalesce(sentiment, F.lit("neutral"))), 0.5)


def shown_as_negative(emotion: Column, sentiment: Column) -> Column:
    return (sentiment == "negative") | emotion.isin(NEGATIVE_DISPLAY)


def flag_category(flag: Column) -> Column:
    return F.upper(F.substring_index(flag, ":", 1))


def flag_detail(flag: Column) -> Column:
    """Everything after the first colon; the whole flag when nothing follows one."""
    at = F.instr(flag, ":")
    has_detail = (at > 0) & (at < F.length(flag))
    return F.when(has_detail, F.substring(flag, at + 1, F.length(flag))).otherwise(flag)


def flag_severity(category: Column) -> Column:
    return F.when(category == "THREAT", "critical").when(category == "ABUSIVE", "warn").otherwise("info")


def component_band(score: Column) -> Column:
    return F.when(score < 60, "red").when(score < 80, "amber").otherwise("green")


def qa_grade(score: Column) -> Column:
    return ladder(score, QA_GRADES, "D")


def peak_section(position: Column) -> Column:
    return F.when(position < 0.33, "beginning").when(position < 0.66, "middle").otherwise("end")


def percent_done(done: Column, stages: int = 9) -> Column:
    """Whole percent, half to even."""
    return F.bround(done / F.lit(stages) * 100, 0).cast("long")
