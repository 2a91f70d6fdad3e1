"""Queries over emotion predictions and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import fusion, lexicon, rules
from callweave.functions.numeric import steady
from callweave.operators import emotion
from callweave.plans import standins
from callweave.plans.oracle import DOC, EMO, SEG, SIG, case_map, rnd, values
from callweave.plans.registry import query

TEXT_EMOTION = case_map({k: v[0] for k, v in lexicon.TEXT_LABELS.items()}, "label", "neutral")
TEXT_SENTIMENT = case_map({k: v[1] for k, v in lexicon.TEXT_LABELS.items()}, "label", "neutral")


def senti(expr: str) -> str:
    return case_map(lexicon.EMOTION_SENTIMENT, expr, "neutral")


def polarity(expr: str) -> str:
    return f"CASE {senti(expr)} WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE"


def predictions(spark, d, seg=None):
    """Turns with a text side and an acoustic side; some turns lack one of them."""
    rows = standins.emotions(standins.segments(spark, d) if seg is None else seg)
    text_side = rows.where("label <> 'surprise'").select(
        "call_id", "seg_idx", rules.emotion_of_label(F.col("label")).alias("emotion"), "confidence"
    )
    sound = rows.where("tone <> 'annoyed'").select(
        "call_id",
        "seg_idx",
        F.col("tone").alias("emotion"),
        F.col("tone_confidence").alias("confidence"),
        F.col("tone_indeterminate").alias("indeterminate"),
    )
    return text_side, sound


# The rules one by one, over (call_id, seg_idx, te, tc, ae, ac, ind); te / ae null where a side is missing.
FUSE_SQL = f"""
pairs AS (SELECT call_id, seg_idx, CASE WHEN label <> 'surprise' THEN {TEXT_EMOTION} END AS te,
    CASE WHEN label <> 'surprise' THEN confidence END AS tc, CASE WHEN tone <> 'annoyed' THEN tone END AS ae,
    CASE WHEN tone <> 'annoyed' THEN tone_confidence END AS ac0, tone_indeterminate AS ind FROM emo),
p1 AS (SELECT *, CASE WHEN te IS NOT NULL AND ind AND ac0 > 0.7 THEN ac0 * 0.5 ELSE ac0 END AS ac FROM pairs WHERE te IS NOT NULL OR ae IS NOT NULL),
p2 AS (SELECT *, 0.55::DOUBLE * (tc / CASE WHEN tc + ac = 0 THEN 1e-8 ELSE tc + ac END) * 2 AS rt,
    0.45::DOUBLE * (ac / CASE WHEN tc + ac = 0 THEN 1e-8 ELSE tc + ac END) * 2 AS ra FROM p1),
p3 AS (SELECT *, CASE WHEN rt + ra > 0 THEN rt / (rt + ra) ELSE 0.55 END::DOUBLE AS wt,
    CASE WHEN rt + ra > 0 THEN ra / (rt + ra) ELSE 0.45 END::DOUBLE AS wa, greatest(least(ac * 2.5, 0.7), 0.5)::DOUBLE AS lift FROM p2),
p4 AS (SELECT *, CASE WHEN ae IS NULL THEN 1 WHEN te IS NULL THEN 2
    WHEN tc > 0.7 AND tc >= ac AND te = 'neutral' AND ae <> 'neutral' AND ac > 0.1 THEN 3 WHEN tc > 0.7 AND tc >= ac THEN 1
    WHEN ac > 0.65 AND ac > tc THEN 2 ELSE 4 END AS rule,
    CASE WHEN wt > wa THEN CASE WHEN te = 'neutral' AND ae <> 'neutral' AND wa > 0.2 THEN ae ELSE te END
      WHEN wa > wt THEN CASE WHEN ae = 'neutral' AND te <> 'neutral' AND wt > 0.3 THEN te ELSE ae END
      ELSE CASE WHEN te <> 'neutral' THEN te ELSE ae END END AS mixed,
    wt * {polarity("te")} * tc + wa * {polarity("ae")} * ac AS blend FROM p3),
fused AS (SELECT call_id, seg_idx, CASE rule WHEN 1 THEN te WHEN 2 THEN ae WHEN 3 THEN ae ELSE mixed END AS emotion,
    CASE rule WHEN 1 THEN {senti("te")} WHEN 2 THEN {senti("ae")} WHEN 3 THEN {senti("ae")}
      ELSE CASE WHEN blend > 0.1 THEN 'positive' WHEN blend < -0.1 THEN 'negative' ELSE 'neutral' END END AS sentiment,
    CASE rule WHEN 1 THEN tc WHEN 2 THEN ac WHEN 3 THEN {rnd("(1 - lift) * tc + lift * ac", 4)} ELSE {rnd("wt * tc + wa * ac", 4)} END AS confidence,
    CASE rule WHEN 1 THEN 'text' WHEN 2 THEN 'acoustic' ELSE 'fused' END AS source,
    CASE rule WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN {rnd("1 - lift", 4)} ELSE {rnd("wt", 4)} END::DOUBLE AS text_weight,
    CASE rule WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN {rnd("lift", 4)} ELSE {rnd("wa", 4)} END::DOUBLE AS acoustic_weight FROM p4)"""


@query("fx1_fusion", f"WITH {SEG}, {EMO}, {FUSE_SQL} SELECT * FROM fused")
def fx1(spark, d):
    return emotion.fuse_sides(*predictions(spark, d))


@query(
    "jn3_outer_pairing",
    f"""WITH {SEG}, {EMO} SELECT call_id, seg_idx, label <> 'surprise' AS has_text, tone <> 'annoyed' AS has_sound FROM emo
        WHERE label <> 'surprise' OR tone <> 'annoyed'""",
)
def jn3(spark, d):
    t, a = predictions(spark, d)
    both = t.withColumn("t", F.lit(True)).select("call_id", "seg_idx", "t").join(
        a.withColumn("a", F.lit(True)).select("call_id", "seg_idx", "a"), ["call_id", "seg_idx"], "full_outer"
    )
    return both.select("call_id", "seg_idx", F.col("t").isNotNull().alias("has_text"), F.col("a").isNotNull().alias("has_sound"))


@query(
    "pf9_label_map",
    f"""WITH {SEG}, {EMO}, x AS (SELECT call_id, seg_idx, CASE WHEN length(text) % 11 = 0 THEN 'boredom' ELSE label END AS label FROM emo)
    SELECT call_id, seg_idx, {TEXT_EMOTION} AS emotion, {TEXT_SENTIMENT} AS sentiment FROM x""",
)
def pf9(spark, d):
    rows = standins.emotions(standins.segments(spark, d))
    label = F.when(F.length("text") % 11 == 0, "boredom").otherwise(F.col("label"))
    return rows.select(
        "call_id", "seg_idx", rules.emotion_of_label(label).alias("emotion"), rules.sentiment_of_label(label).alias("sentiment")
    )


@query(
    "pf13_negative_display",
    f"""WITH {SEG}, {EMO} SELECT call_id, seg_idx, ({senti("tone")}) = 'negative' OR label IN ('anger', 'sadness', 'disgust') AS shown FROM emo""",
)
def pf13(spark, d):
    rows = standins.emotions(standins.segments(spark, d))
    return rows.select(
        "call_id", "seg_idx", rules.shown_as_negative(F.col("label"), rules.sentiment_of_emotion(F.col("tone"))).alias("shown")
    )


@query(
    "pf15_source_choice",
    f"""WITH {SEG}, {EMO}, x AS (SELECT call_id, seg_idx, CASE WHEN tone_confidence >= 0.2 THEN tone END AS ae,
        CASE WHEN tone_confidence >= 0.2 THEN tone_confidence END AS ac, CASE WHEN confidence >= 0.3 THEN {TEXT_EMOTION} END AS te,
        CASE WHEN confidence >= 0.3 THEN confidence END AS tc FROM emo)
    SELECT call_id, seg_idx, CASE WHEN te IS NULL AND ae IS NULL THEN 'none' WHEN ae IS NULL THEN 'text' WHEN te IS NULL THEN 'acoustic' ELSE 'both' END AS source,
      CASE WHEN te IS NULL AND ae IS NULL THEN 'neutral' WHEN ae IS NULL THEN te WHEN te IS NULL THEN ae ELSE 'both' END AS emotion,
      CASE WHEN te IS NULL AND ae IS NULL THEN 0 WHEN ae IS NULL THEN tc WHEN te IS NULL THEN ac ELSE -1 END::DOUBLE AS confidence FROM x""",
)
def pf15(spark, d):
    rows = standins.emotions(standins.segments(spark, d))
    t, a = F.col("confidence") >= 0.3, F.col("tone_confidence") >= 0.2
    sides = rows.select(
        "call_id",
        "seg_idx",
        F.when(t, rules.emotion_of_label(F.col("label"))).alias("text_emotion"),
        F.when(t, F.col("confidence")).alias("text_confidence"),
        F.when(a, F.col("tone")).alias("acoustic_emotion"),
        F.when(a, F.col("tone_confidence")).alias("acoustic_confidence"),
        F.lit(False).alias("acoustic_indeterminate"),
    )
    both = F.col("text_emotion").isNotNull() & F.col("acoustic_emotion").isNotNull()
    out = fusion.fuse(sides)
    return out.select(
        "call_id",
        "seg_idx",
        F.when(both, "both").otherwise(F.col("fused.source")).alias("source"),
        F.when(both, "both").otherwise(F.col("fused.emotion")).alias("emotion"),
        F.when(both, -1.0).otherwise(F.col("fused.confidence")).alias("confidence"),
    )


# --- lexicon scorer ----------------------------------------------------------------------------
WORD_WEIGHTS = {
    "idiot": ("anger", 1.5),
    "stupid": ("anger", 1.2),
    "worthless": ("disgust", 1.4),
    "pathetic": ("disgust", 1.1),
    "disgusting": ("disgust", 1.6),
    "threat": ("fear", 1.0),
    "love": ("joy", 1.0),
    "the": ("neutral", 0.05),
    "and": ("neutral", 0.04),
    "est": ("joy", 0.06),
    "und": ("sadness", 0.06),
    "de": ("surprise", 0.03),
}
_LABELS = sorted({lab for lab, _ in WORD_WEIGHTS.values()})


@query(
    "ud1_lexicon_scorer",
    rf"""WITH {DOC}, lx AS {values([(w, lab, x) for w, (lab, x) in WORD_WEIGHTS.items()], "tok, lab, w")},
    t AS (SELECT call_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS tok FROM doc),
    s AS (SELECT call_id, lab, round(sum(w::DOUBLE), 9) AS s FROM t JOIN lx ON t.tok = lx.tok GROUP BY call_id, lab),
    c AS (SELECT DISTINCT call_id FROM s),
    f AS (SELECT c.call_id, l.lab, coalesce(s.s, 0.0) AS s FROM c, (SELECT DISTINCT lab FROM lx) l LEFT JOIN s ON s.call_id = c.call_id AND s.lab = l.lab),
    e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY call_id)) AS e FROM f),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY call_id) AS p FROM e),
    b AS (SELECT call_id, lab AS label, p FROM p QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY round(p, 12) DESC, lab) = 1),
    r AS (SELECT d.call_id, coalesce(label, 'neutral') AS label, coalesce({rnd("p", 4)}, 0.0) AS confidence FROM doc d LEFT JOIN b ON d.call_id = b.call_id)
    SELECT call_id, {TEXT_EMOTION} AS emotion, {TEXT_SENTIMENT} AS sentiment, confidence FROM r""",
)
def ud1(spark, d):
    scorer = emotion.lexicon_scorer(WORD_WEIGHTS, ("call_id",))
    return emotion.score_text(standins.documents(spark, d), scorer).select("call_id", "emotion", "sentiment", "confidence")


@query("ud1_trained_scorer")
def ud1b(spark, d):
    docs = standins.documents(spark, d)
    labels = standins.table(spark, d, "labels").select(F.col("doc_id").alias("call_id"), F.col("toxic").cast("double").alias("label"))
    model = emotion.train_text_classifier(docs.join(labels, "call_id"), features=1 << 14)
    return model.transform(docs).select("call_id", F.col("prediction").cast("long").alias("predicted_toxic"))


# --- acoustic side -----------------------------------------------------------------------------
def prosody_rows(spark, d):
    """Every frame as a turn with five features."""
    v = F.col("value")
    return standins.frames(spark, d).select(
        "call_id",
        F.col("frame_idx").alias("seg_idx"),
        F.when(F.col("event_type").isin("error", "click"), "spk_0").otherwise("spk_1").alias("speaker"),
        (v % 10 / 5).alias("duration_s"),
        (v + 80.0).alias("pitch_mean"),
        (v / 100.0).alias("rms_mean"),
        (v * 7 % 50).alias("speaking_rate_zcr"),
        (v % 7 / 10).alias("jitter"),
        (v % 3 / 10).alias("pause_ratio"),
        rules.peak_section(v % 1).alias("hif0_section"),
    )


PROSODY = f"""{SIG}, pr AS (SELECT call_id, frame_idx AS seg_idx, CASE WHEN event_type IN ('error', 'click') THEN 'spk_0' ELSE 'spk_1' END AS speaker,
  value % 10 / 5 AS duration_s, value + 80.0 AS f0, value / 100.0 AS f1, (value * 7 % 50) AS f2, value % 7 / 10 AS f3, value % 3 / 10 AS f4,
  CASE WHEN value % 1 < 0.33 THEN 'beginning' WHEN value % 1 < 0.66 THEN 'middle' ELSE 'end' END AS sec FROM fr),
bl AS (SELECT *, count(*) OVER w AS n, {", ".join(f"avg(f{i}) OVER w AS m{i}, stddev_pop(f{i}) OVER w AS s{i}" for i in range(5))} FROM pr WHERE duration_s >= 0.3
  WINDOW w AS (PARTITION BY call_id, speaker ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dl AS (SELECT call_id, seg_idx, speaker, n, sec,
  {", ".join(f"CASE WHEN n >= 3 THEN greatest(least((f{i} - m{i}) / (CASE WHEN s{i} <= 1e-5 THEN 1.0 ELSE s{i} END + 1e-5), 5.0), -5.0) END AS d{i}" for i in range(5))} FROM bl)"""


@query(
    "wn7_speaker_baseline",
    f"""WITH {PROSODY} SELECT call_id, seg_idx, n AS prior_n, n >= 3 AS has_baseline,
      {", ".join(f"{rnd(f'm{i}', 4)} AS {f}_mean, {rnd(f's{i}', 4)} AS {f}_std" for i, f in enumerate(emotion.FEATURES))} FROM bl""",
)
def wn7(spark, d):
    rows = prosody_rows(spark, d).where("duration_s >= 0.3")
    out = emotion.speaker_deltas(rows)
    return out.select(
        "call_id",
        "seg_idx",
        F.col("prior_n").cast("long").alias("prior_n"),
        "has_baseline",
        *[steady(F.col(f"{f}_{k}"), 4).alias(f"{f}_{k}") for f in emotion.FEATURES for k in ("mean", "std")],
    )


@query(
    "wn8_feature_deltas",
    f"""WITH {PROSODY} SELECT call_id, seg_idx, {", ".join(f"{rnd(f'd{i}', 4)} AS {f}" for i, f in enumerate(emotion.DELTAS))} FROM dl WHERE n >= 3""",
)
def wn8(spark, d):
    rows = emotion.speaker_deltas(prosody_rows(spark, d).where("duration_s >= 0.3")).where("has_baseline")
    return rows.select("call_id", "seg_idx", *[steady(F.col(c), 4).alias(c) for c in emotion.DELTAS])


_PROFILES = values([(i, n, *p, peak) for i, (n, (p, peak)) in enumerate(lexicon.ACOUSTIC_PROFILES.items())], "k, emotion, p0, p1, p2, p3, p4, peak")
_DIST = " + ".join(f"{w}::DOUBLE * (d{i} - p{i}) * (d{i} - p{i})" for i, w in enumerate(lexicon.ACOUSTIC_WEIGHTS))
SIMS = f"""pf AS {_PROFILES}, sm AS (SELECT call_id, seg_idx, k, emotion, 1.0 / (1.0 + sqrt({_DIST})) + CASE WHEN peak = sec THEN 0.10 ELSE 0 END AS sim
  FROM dl, pf WHERE n >= 3)"""


@query("jn10_profile_similarity", f"WITH {PROSODY}, {SIMS} SELECT call_id, seg_idx, emotion, {rnd('sim', 6)} AS similarity FROM sm")
def jn10(spark, d):
    rows = emotion.speaker_deltas(prosody_rows(spark, d).where("duration_s >= 0.3")).where("has_baseline")
    rows = rows.withColumn("__d", F.array(*emotion.DELTAS))
    sims = F.array(
        *[
            F.struct(F.lit(n).alias("emotion"), emotion.profile_similarity(F.col("__d"), p, peak, F.col("hif0_section")).alias("s"))
            for n, (p, peak) in lexicon.ACOUSTIC_PROFILES.items()
        ]
    )
    return rows.select("call_id", "seg_idx", F.inline(sims)).select("call_id", "seg_idx", "emotion", steady(F.col("s"), 6).alias("similarity"))


@query(
    "fx7_acoustic_emotion",
    f"""WITH {PROSODY}, {SIMS}, e AS (SELECT *, exp((sim - max(sim) OVER w) / 0.35) AS e FROM sm WINDOW w AS (PARTITION BY call_id, seg_idx)),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY call_id, seg_idx) AS p FROM e),
    t AS (SELECT call_id, seg_idx, emotion, p FROM p QUALIFY row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY round(p, 12) DESC, k) = 1)
    SELECT r.call_id, r.seg_idx, coalesce(t.emotion, 'neutral') AS emotion, coalesce({rnd("t.p", 4)}, 0.0) AS confidence,
      coalesce(t.p < 0.20, true) AS indeterminate FROM pr r LEFT JOIN t ON r.call_id = t.call_id AND r.seg_idx = t.seg_idx""",
)
def fx7(spark, d):
    return emotion.acoustic_emotions(prosody_rows(spark, d)).select("call_id", "seg_idx", "emotion", "confidence", "indeterminate")


@query(
    "ag10_sentiment_mode",
    f"""WITH {SEG}, {EMO}, {FUSE_SQL}, c AS (SELECT call_id, sentiment, count(*) AS n, min(seg_idx) AS f FROM fused GROUP BY call_id, sentiment)
    SELECT call_id, sentiment AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY n DESC, f) = 1""",
)
def ag10(spark, d):
    return emotion.sentiment_mode(emotion.fuse_sides(*predictions(spark, d)))


@query(
    "ag10_sentiment_counts",
    f"""WITH {SEG}, {EMO}, {FUSE_SQL}, c AS (SELECT call_id, count(*) FILTER (sentiment = 'negative') AS n_negative,
      count(*) FILTER (sentiment = 'positive') AS n_positive, count(*) FILTER (sentiment = 'neutral') AS n_neutral FROM fused GROUP BY call_id)
    SELECT *, CASE WHEN n_negative > n_positive AND n_negative > n_neutral THEN 'Negative' WHEN n_positive > n_negative THEN 'Positive' ELSE 'Neutral' END AS tone FROM c""",
)
def ag10c(spark, d):
    return emotion.sentiment_counts(emotion.fuse_sides(*predictions(spark, d)))
