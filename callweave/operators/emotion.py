"""Text scorers, speaker baselines, acoustic profiles and pairing both sides for fusion."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import lexicon
from callweave.functions.fusion import fuse
from callweave.functions.numeric import block_of, steady
from callweave.functions.rules import emotion_of_label, sentiment_of_label, too_short_to_judge
from callweave.functions.text import scoring_text, tokens
from callweave.functions.vectors import total
from callweave.operators.scans import BLOCK_ROWS, expanding_moments, shared

FEATURES = ["pitch_mean", "rms_mean", "speaking_rate_zcr", "jitter", "pause_ratio"]
DELTAS = ["pitch_d", "energy_d", "rate_d", "jitter_d", "pause_r"]


def score_text(
    turns: DataFrame, scorer: Callable[[DataFrame], DataFrame], text: str = "text", limit: int | None = None
) -> DataFrame:
    """Run a scorer over prepared text and map its labels.

    Scorers get the whole text; ``limit`` is for models whose input has a greatest length.

    ``scorer`` gets the rows with ``scoring_text`` and adds ``label`` and ``confidence``.
    """
    scored = scorer(turns.withColumn("scoring_text", scoring_text(F.coalesce(F.col(text), F.lit("")), limit)))
    return scored.withColumns(
        {
            "emotion": emotion_of_label(F.col("label")),
            "sentiment": sentiment_of_label(F.col("label")),
            "confidence": steady(F.col("confidence"), 4),
        }
    ).drop("scoring_text")


def lexicon_scorer(
    weights: Mapping[str, tuple[str, float]], keys: tuple[str, ...] = ("call_id", "seg_idx")
) -> Callable[[DataFrame], DataFrame]:
    """Scorer from word weights: softmax over the summed weight per label.

    ``weights`` maps a word to (label, weight). A text without any listed word is neutral with
    confidence 0. Ties go to the label that comes first in the alphabet; sums are taken to 9 digits and
    shares compared to 12, so the order of summation decides none.
    """
    labels = sorted({label for label, _ in weights.values()})

    def scorer(df: DataFrame) -> DataFrame:
        entries = F.array(
            *[
                F.struct(F.lit(w).alias("token"), F.lit(lab).alias("w_label"), F.lit(float(x)).alias("w"))
                for w, (lab, x) in weights.items()
            ]
        )
        table = df.sparkSession.range(1).select(F.inline(entries))
        hits = (
            df.select(*keys, F.explode(tokens(F.col("scoring_text"))).alias("token"))
            .join(F.broadcast(table), "token")
            .groupBy(*keys)
            .agg(*[F.sum(F.when(F.col("w_label") == lab, F.col("w")).otherwise(0.0)).alias(f"__s_{lab}") for lab in labels])
        )
        sums = F.array(*[F.round(F.col(f"__s_{lab}"), 9) for lab in labels])
        exps = F.transform(sums, lambda x: F.exp(x - F.array_max(sums)))
        hits = hits.select(*keys, exps.alias("__e"))
        hits = hits.withColumn("__p", F.transform("__e", lambda x: x / total(F.col("__e"))))
        names = F.array(*[F.lit(lab) for lab in labels])
        compared = F.transform("__p", lambda x: F.round(x, 12))
        hits = hits.select(
            *keys,
            F.element_at(names, F.array_position(compared, F.array_max(compared)).cast("int")).alias("label"),
            F.array_max("__p").alias("confidence"),
            F.map_from_arrays(names, F.transform("__p", lambda x: steady(x, 4))).alias("all_scores"),
        )
        return (
            df.join(hits, list(keys), "left")
            .withColumn("label", F.coalesce("label", F.lit("neutral")))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        )

    return scorer


def train_text_classifier(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """Fit a bag-of-words classifier (hashed TF-IDF and logistic regression) on labelled text."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    steps = [
        RegexTokenizer(inputCol=text, outputCol="__tok", pattern=lexicon_token_pattern(), gaps=False),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__idf", minDocFreq=2),
        LogisticRegression(featuresCol="__idf", labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=steps).fit(labelled)


def lexicon_token_pattern() -> str:
    from callweave.functions.text import WORD

    return WORD


def z_delta(value: Column, mean: Column, std: Column, epsilon: float = 1e-5) -> Column:
    """Deviation from the baseline in standard deviations, clipped to +-5; a flat baseline counts as 1."""
    spread = F.when(F.coalesce(std, F.lit(1.0)) <= 1e-5, F.lit(1.0)).otherwise(F.coalesce(std, F.lit(1.0)))
    z = (value - F.coalesce(mean, value)) / (spread + F.lit(epsilon))
    return F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0))


def speaker_deltas(prosody: DataFrame, min_prior: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deviations of each turn from the same speaker's earlier turns.

    Adds ``prior_n``, the five deltas and ``has_baseline``. Turns shorter than 0.3 s must be left
    out before, because they neither get nor shape a baseline.
    """
    out = expanding_moments(
        shared(prosody), ["call_id", "speaker"], ["seg_idx"], block_of(F.col("seg_idx"), block_rows), FEATURES
    )
    # One earlier turn has no spread of its own; it counts as 1.
    std = {f: F.when(F.col("prior_n") > 1, F.col(f"{f}_std")).otherwise(1.0) for f in FEATURES}
    out = out.withColumn("has_baseline", F.col("prior_n") >= min_prior)
    return out.withColumns(
        {
            d: F.when(F.col("has_baseline"), z_delta(F.col(f), F.col(f"{f}_mean"), std[f]))
            for f, d in zip(FEATURES, DELTAS, strict=True)
        }
    )


def profile_similarity(deltas: Column, profile: list[float], peak: str, section: Column) -> Column:
    """1 / (1 + weighted distance), plus a bonus when the pitch peak lies where the profile has it."""
    squares = [
        F.lit(w) * (deltas[i] - F.lit(p)) * (deltas[i] - F.lit(p))
        for i, (w, p) in enumerate(zip(lexicon.ACOUSTIC_WEIGHTS, profile, strict=True))
    ]
    distance = F.sqrt(sum(squares[1:], squares[0]))
    bonus = F.when(section == peak, lexicon.ACOUSTIC_POSITION_BONUS).otherwise(0.0)
    return 1.0 / (1.0 + distance) + bonus


def classify_acoustic(df: DataFrame, section: str = "hif0_section") -> DataFrame:
    """Add emotion, confidence, indeterminate and all_scores from the five delta columns.

    The eight profiles are unrolled into the projection, so there is nothing to join.
    """
    deltas = F.array(*[F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in DELTAS])
    out = df.withColumn("__d", deltas)
    sims = F.array(
        *[
            profile_similarity(F.col("__d"), p, peak, F.col(section))
            for p, peak in lexicon.ACOUSTIC_PROFILES.values()
        ]
    )
    # Maximum and sum are columns of their own; inside a lambda they would be computed per element.
    out = out.withColumn("__s", sims).withColumn("__m", F.array_max("__s"))
    out = out.withColumn(
        "__e", F.transform("__s", lambda s: F.exp((s - F.col("__m")) / lexicon.ACOUSTIC_TEMPERATURE))
    ).withColumn("__t", total(F.col("__e")))
    out = out.withColumn("__p", F.transform("__e", lambda e: e / F.col("__t")))
    names = F.array(*[F.lit(n) for n in lexicon.ACOUSTIC_PROFILES])
    top = F.array_max("__p")
    return out.withColumns(
        {
            "emotion": F.element_at(names, F.array_position("__p", top).cast("int")),
            "confidence": steady(top, 4),
            "indeterminate": top < lexicon.ACOUSTIC_MIN_CONFIDENCE,
            "all_scores": F.map_from_arrays(names, F.transform("__p", lambda x: steady(x, 4))),
        }
    ).drop("__d", "__s", "__m", "__e", "__t", "__p")


def acoustic_emotions(prosody: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Acoustic emotion per turn; short turns and turns without a baseline are neutral at 0."""
    long_enough = prosody.where(~too_short_to_judge(F.col("duration_s")))
    judged = classify_acoustic(speaker_deltas(long_enough, block_rows=block_rows))
    none = F.lit(None).cast("map<string,double>")
    based = F.col("has_baseline")
    judged = judged.select(
        "call_id",
        "seg_idx",
        F.when(based, F.col("emotion")).otherwise("neutral").alias("emotion"),
        F.when(based, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(based, F.col("indeterminate")).otherwise(True).alias("indeterminate"),
        F.when(based, F.col("all_scores")).otherwise(none).alias("all_scores"),
    )
    short = prosody.where(too_short_to_judge(F.col("duration_s"))).select(
        "call_id",
        "seg_idx",
        F.lit("neutral").alias("emotion"),
        F.lit(0.0).alias("confidence"),
        F.lit(True).alias("indeterminate"),
        none.alias("all_scores"),
    )
    return judged.unionByName(short)


def fuse_sides(text_side: DataFrame, acoustic_side: DataFrame) -> DataFrame:
    """Pair predictions by (call, turn) and fuse; a side without a partner passes through."""
    t = text_side.select(
        "call_id", "seg_idx", F.col("emotion").alias("text_emotion"), F.col("confidence").alias("text_confidence")
    )
    a = acoustic_side.select(
        "call_id",
        "seg_idx",
        F.col("emotion").alias("acoustic_emotion"),
        F.col("confidence").alias("acoustic_confidence"),
        F.col("indeterminate").alias("acoustic_indeterminate"),
    )
    paired = fuse(t.join(a, ["call_id", "seg_idx"], "full_outer"))
    return paired.select("call_id", "seg_idx", "fused.*")


def sentiment_mode(emotions: DataFrame, name: str = "dominant") -> DataFrame:
    """Most frequent sentiment per call; the one seen first wins a tie."""
    counts = emotions.groupBy("call_id", F.lower("sentiment").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seg_idx").alias("first")
    )
    return counts.groupBy("call_id").agg(F.max_by("s", F.struct("n", -F.col("first"))).alias(name))


def sentiment_counts(emotions: DataFrame) -> DataFrame:
    """Counts per sentiment and the overall tone."""
    s = F.lower("sentiment")
    n = {k: F.count_if(s == k) for k in ("negative", "positive", "neutral")}
    out = emotions.groupBy("call_id").agg(*[c.alias(f"n_{k}") for k, c in n.items()])
    neg, pos, neu = (F.col(f"n_{k}") for k in n)
    tone = F.when((neg > pos) & (neg > neu), "Negative").when(pos > neg, "Positive").otherwise("Neutral")
    return out.withColumn("tone", tone)
