"""Confidence-gated fusion of a text and an acoustic emotion prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.numeric import steady
from callweave.functions.rules import sentiment_of_emotion

TEXT_GATE, ACOUSTIC_GATE = 0.70, 0.65
TEXT_SHARE, ACOUSTIC_SHARE = 0.55, 0.45


def _polarity(emotion: Column) -> Column:
    s = sentiment_of_emotion(emotion)
    return F.when(s == "positive", 1.0).when(s == "negative", -1.0).otherwise(0.0)


def _verdict(emotion, sentiment, confidence, source, w_text, w_acoustic) -> Column:
    return F.struct(
        emotion.alias("emotion"),
        sentiment.alias("sentiment"),
        confidence.cast("double").alias("confidence"),
        F.lit(source).alias("source"),
        w_text.cast("double").alias("text_weight"),
        w_acoustic.cast("double").alias("acoustic_weight"),
    )


def fuse(df: DataFrame, out: str = "fused") -> DataFrame:
    """Add a fused prediction from ``text_emotion``, ``text_confidence``, ``acoustic_emotion``,
    ``acoustic_confidence`` and ``acoustic_indeterminate``.

    A side that is missing (null emotion and null confidence) hands the decision to the other one.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    df = df.withColumns(
        {
            "__te": F.lower(F.coalesce("text_emotion", F.lit("neutral"))),
            "__ae": F.lower(F.coalesce("acoustic_emotion", F.lit("neutral"))),
            "__t": F.coalesce("text_confidence", zero),
            "__a": F.coalesce("acoustic_confidence", zero)
            * F.when(
                F.coalesce("acoustic_indeterminate", F.lit(False)) & (F.col("acoustic_confidence") > TEXT_GATE),
                0.5,
            ).otherwise(1.0),
        }
    )
    t, a, te, ae = (F.col(c) for c in ("__t", "__a", "__te", "__ae"))
    total = F.when(t + a == 0, F.lit(1e-8)).otherwise(t + a)
    df = df.withColumns(
        {"__rt": TEXT_SHARE * (t / total) * 2, "__ra": ACOUSTIC_SHARE * (a / total) * 2}
    )
    both = F.col("__rt") + F.col("__ra")
    df = df.withColumns(
        {
            "__wt": F.when(both > 0, F.col("__rt") / both).otherwise(TEXT_SHARE),
            "__wa": F.when(both > 0, F.col("__ra") / both).otherwise(ACOUSTIC_SHARE),
            "__lift": F.greatest(F.least(a * 2.5, F.lit(0.7)), F.lit(0.5)),
        }
    )
    wt, wa, lift = F.col("__wt"), F.col("__wa"), F.col("__lift")
    blend = wt * _polarity(te) * t + wa * _polarity(ae) * a
    blend_sentiment = F.when(blend > 0.10, "positive").when(blend < -0.10, "negative").otherwise("neutral")
    t_flat, a_flat = te == "neutral", ae == "neutral"
    blend_emotion = (
        F.when(wt > wa, F.when(t_flat & ~a_flat & (wa > 0.2), ae).otherwise(te))
        .when(wa > wt, F.when(a_flat & ~t_flat & (wt > 0.3), te).otherwise(ae))
        .otherwise(F.when(~t_flat, te).otherwise(ae))
    )
    text_only = _verdict(te, sentiment_of_emotion(te), t, "text", one, zero)
    acoustic_only = _verdict(ae, sentiment_of_emotion(ae), a, "acoustic", zero, one)
    unpaired_acoustic = _verdict(
        ae, sentiment_of_emotion(ae), F.coalesce("acoustic_confidence", zero), "acoustic", zero, one
    )
    lifted = _verdict(
        ae,
        sentiment_of_emotion(ae),
        steady((1 - lift) * t + lift * a, 4),
        "fused",
        steady(1 - lift, 4),
        steady(lift, 4),
    )
    blended = _verdict(
        blend_emotion, blend_sentiment, steady(wt * t + wa * a, 4), "fused", steady(wt, 4), steady(wa, 4)
    )
    nobody = _verdict(F.lit("neutral"), F.lit("neutral"), zero, "none", zero, zero)
    no_text = F.col("text_emotion").isNull() & F.col("text_confidence").isNull()
    no_sound = F.col("acoustic_emotion").isNull() & F.col("acoustic_confidence").isNull()
    text_leads = (t > TEXT_GATE) & (t >= a)
    rule = (
        F.when(no_text & no_sound, nobody)
        .when(no_sound, text_only)
        .when(no_text, unpaired_acoustic)
        .when(text_leads & t_flat & ~a_flat & (a > 0.10), lifted)
        .when(text_leads, text_only)
        .when((a > ACOUSTIC_GATE) & (a > t), acoustic_only)
        .otherwise(blended)
    )
    helpers = ["__te", "__ae", "__t", "__a", "__rt", "__ra", "__wt", "__wa", "__lift"]
    return df.withColumn(out, rule).drop(*helpers)
