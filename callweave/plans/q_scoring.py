"""Queries over call scores, grades and notes, and the flagship analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import rules
from callweave.functions.lexicon import QA_WEIGHTS
from callweave.operators import compliance, emotion, notes, scoring, turns
from callweave.plans import standins
from callweave.plans.oracle import DIAR, DOC, EMO, NWS, SEG, WS, grade_case, lit, rnd
from callweave.plans.q_compliance import SEG_POLICY, SEG_VIO
from callweave.plans.q_emotion import FUSE_SQL, predictions
from callweave.plans.registry import query
from callweave.session import materialize
from callweave.sources import store


@query(
    "ag1_talk_ratio",
    f"""WITH {DIAR}, s AS (SELECT call_id, sum(CASE WHEN speaker = 'spk_0' THEN duration_s ELSE 0 END) AS a,
      sum(CASE WHEN speaker = 'spk_1' THEN duration_s ELSE 0 END) AS c, sum(CASE WHEN speaker NOT IN ('spk_0', 'spk_1') THEN duration_s ELSE 0 END) AS o,
      count(*) FILTER (speaker = 'spk_0') AS agent_segments, count(*) FILTER (speaker = 'spk_1') AS customer_segments,
      count(*) FILTER (speaker NOT IN ('spk_0', 'spk_1')) AS overlap_segments FROM diar GROUP BY call_id)
    SELECT call_id, {rnd("a", 2)} AS agent_duration_s, {rnd("c", 2)} AS customer_duration_s, {rnd("o", 2)} AS overlap_duration_s,
      {rnd("a + c", 2)} AS total_speech_s, {rnd("CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0 END", 4)} AS agent_ratio,
      {rnd("CASE WHEN a + c > 0 THEN c / (a + c) ELSE 0 END", 4)} AS customer_ratio, agent_segments, customer_segments, overlap_segments FROM s""",
)
def ag1(spark, d):
    return scoring.talk_ratio(standins.diarized(spark, d))


@query(
    "ag2_speaker_counts",
    f"""WITH {DIAR} SELECT call_id, count(*) FILTER (speaker = 'spk_0') AS agent_segments,
      count(*) FILTER (speaker = 'spk_1') AS customer_segments, count(*) FILTER (speaker NOT IN ('spk_0', 'spk_1')) AS overlap_segments
    FROM diar GROUP BY call_id""",
)
def ag2(spark, d):
    out = scoring.talk_ratio(standins.diarized(spark, d))
    return out.select("call_id", "agent_segments", "customer_segments", "overlap_segments")


def scored_turns(spark, d):
    """Turns with fused sentiment and violation counts; the turn table is built once."""
    seg = materialize(standins.segments(spark, d), "turns")
    fused = emotion.fuse_sides(*predictions(spark, d, seg))
    flags = compliance.turn_flags(seg, compliance.violations(seg, SEG_POLICY))
    return (
        seg.join(fused.select("call_id", "seg_idx", "emotion", "sentiment", "confidence"), ["call_id", "seg_idx"], "left")
        .join(flags.select("call_id", "seg_idx", "violation_count", "flags"), ["call_id", "seg_idx"])
        .withColumn("sentiment", F.coalesce("sentiment", F.lit("neutral")))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    )


SCORED = f"""{SEG_VIO}, {EMO}, {FUSE_SQL},
vc AS (SELECT call_id, seg_idx, count(*) AS n FROM vio GROUP BY call_id, seg_idx),
st AS (SELECT s.*, coalesce(f.sentiment, 'neutral') AS sentiment, coalesce(f.confidence, 0.0) AS confidence, coalesce(vc.n, 0) AS v
  FROM seg s LEFT JOIN fused f ON s.call_id = f.call_id AND s.seg_idx = f.seg_idx LEFT JOIN vc ON s.call_id = vc.call_id AND s.seg_idx = vc.seg_idx),
sv AS (SELECT *, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.0 ELSE 0.5 END::DOUBLE AS base FROM st),
q0 AS (SELECT call_id, count(*) AS n_turns, avg(base * confidence + 0.5 * (1 - confidence)) FILTER (speaker = 'customer') AS cust,
  sum(v)::BIGINT AS total_violations, coalesce(sum(v) FILTER (speaker = 'agent'), 0)::BIGINT AS agent_violations,
  count(*) FILTER (speaker = 'agent') AS n_agent, var_pop(base) FILTER (speaker = 'agent') AS spread,
  avg(CASE WHEN sentiment = 'positive' THEN 1.0 ELSE 0.0 END) AS pos,
  coalesce(sum(end_time_s - start_time_s) FILTER (speaker = 'agent'), 0) / sum(end_time_s - start_time_s) * 100 AS share FROM sv GROUP BY call_id),
q1 AS (SELECT call_id, n_turns, total_violations, agent_violations, {rnd("coalesce(cust * 100, 50.0)", 1)} AS customer_sentiment,
  CASE WHEN total_violations = 0 THEN 100.0 ELSE greatest(0, 100 - least(10 * total_violations + 5 * agent_violations, 100)) END::DOUBLE AS compliance,
  CASE n_agent WHEN 0 THEN 75.0 WHEN 1 THEN 80.0 ELSE {rnd("greatest(0, 1 - spread * 4) * 100", 1)} END::DOUBLE AS agent_stability,
  {rnd("least(70.0 + CASE WHEN total_violations = 0 THEN 15.0 ELSE 0.0 END + pos * 15, 100.0)", 1)} AS intent_resolution,
  CASE WHEN round(share, 9) BETWEEN 35 AND 65 THEN 100.0 ELSE {rnd("greatest(0, 100 - least(abs(share - 50), 50.0) * 2)", 1)} END::DOUBLE AS talk_ratio FROM q0),
q2 AS (SELECT *, {rnd("least(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in QA_WEIGHTS.items()) + ", 100.0)", 1)} AS qa_score FROM q1),
qa AS (SELECT *, {grade_case("qa_score")} AS grade FROM q2)"""


@query(
    "ag4_to_ag8_components",
    f"""WITH {SCORED} SELECT call_id, customer_sentiment, compliance, agent_stability, intent_resolution, talk_ratio FROM qa""",
)
def components(spark, d):
    return scoring.component_scores(scored_turns(spark, d)).select("call_id", *scoring.COMPONENTS)


@query("ag9_qa_grade", f"WITH {SCORED} SELECT call_id, qa_score, grade FROM qa")
def ag9(spark, d):
    return scoring.grade_calls(scoring.component_scores(scored_turns(spark, d))).select("call_id", "qa_score", "grade")


@query(
    "pf12_component_band",
    f"""WITH {SCORED}, b AS (UNPIVOT (SELECT call_id, customer_sentiment, compliance, agent_stability, intent_resolution, talk_ratio FROM qa)
      ON customer_sentiment, compliance, agent_stability, intent_resolution, talk_ratio INTO NAME component VALUE score)
    SELECT call_id, component, CASE WHEN score < 60 THEN 'red' WHEN score < 80 THEN 'amber' ELSE 'green' END AS band FROM b""",
)
def pf12(spark, d):
    rows = scoring.component_scores(scored_turns(spark, d)).unpivot("call_id", scoring.COMPONENTS, "component", "score")
    return rows.select("call_id", "component", rules.component_band(F.col("score")).alias("band"))


@query(
    "pf5_empty_transcript_guard",
    f"""WITH {SCORED}, g AS (SELECT call_id, max(CASE WHEN call_id % 5 <> 0 AND regexp_matches(text, '{NWS}') THEN 1 ELSE 0 END) AS ok FROM seg GROUP BY call_id)
    SELECT g.call_id, CASE WHEN ok = 0 THEN 'no transcript' END AS audit_skipped, CASE WHEN ok = 1 THEN qa_score END AS qa_score,
      CASE WHEN ok = 1 THEN grade END AS grade FROM g JOIN qa ON g.call_id = qa.call_id""",
)
def pf5(spark, d):
    seg = standins.segments(spark, d)
    blanked = seg.withColumn("text", F.when(F.col("call_id") % 5 == 0, "   ").otherwise(F.col("text")))
    scores = scoring.grade_calls(scoring.component_scores(scored_turns(spark, d))).select("call_id", "qa_score", "grade")
    return scoring.blank_scores_for_skipped(scores, turns.empty_transcript_guard(blanked))


@query(
    "io5_weight_table",
    f"""WITH {SCORED}, w AS (SELECT r_regionkey AS k, r_regionkey >= 2 AS o, r_regionkey * 0.1::DOUBLE AS cs FROM region),
    x AS (SELECT qa.*, CASE WHEN o THEN cs * customer_sentiment + 0.5::DOUBLE * compliance ELSE
      {" + ".join(f"{v}::DOUBLE * {c}" for c, v in QA_WEIGHTS.items())} END AS raw FROM qa JOIN w ON qa.call_id % 5 = w.k)
    SELECT call_id, {rnd("least(raw, 100.0)", 1)} AS qa_score FROM x""",
)
def io5(spark, d):
    region = standins.table(spark, d, "region").select(
        F.col("r_regionkey").cast("long").alias("profile"),
        F.when(
            F.col("r_regionkey") >= 2,
            F.create_map(F.lit("customer_sentiment"), F.col("r_regionkey") * 0.1, F.lit("compliance"), F.lit(0.5)),
        ).alias("weights"),
    )
    comps = scoring.component_scores(scored_turns(spark, d)).withColumn("profile", F.col("call_id") % 5)
    rows = comps.join(region, "profile")
    return scoring.grade_calls(rows, scoring.weight_columns(table=F.col("weights"))).select("call_id", "qa_score")


@query(
    "ag30_call_summary",
    f"""WITH {SCORED} SELECT call_id, n_turns AS total_segments, total_violations, qa_score, grade, total_violations = 0 AS compliant FROM qa""",
)
def ag30(spark, d):
    out = scoring.grade_calls(scoring.component_scores(scored_turns(spark, d)))
    return out.select(
        "call_id",
        F.col("n_turns").alias("total_segments"),
        "total_violations",
        "qa_score",
        "grade",
        (F.col("total_violations") == 0).alias("compliant"),
    )


@query(
    "ag29_history_rollup",
    f"""WITH {SCORED}, c AS (SELECT *, total_violations = 0 AS compliant FROM qa)
    SELECT grade, compliant, grouping_id(grade, compliant)::BIGINT AS level, count(*) AS n_calls, {rnd("avg(qa_score)", 4)} AS avg_score,
      sum(total_violations)::BIGINT AS violations FROM c GROUP BY ROLLUP (grade, compliant)""",
)
def ag29(spark, d):
    out = scoring.grade_calls(scoring.component_scores(scored_turns(spark, d)))
    return scoring.history(out.withColumn("compliant", F.col("total_violations") == 0))


ACTION = """CASE WHEN total_violations = 0 AND grade IN ('A', 'B') THEN 'No action required. Call met quality standards.'
  WHEN total_violations > 0 AND agent_violations > 0 THEN 'Flag for compliance review. Agent violations detected.'
  WHEN grade = 'D' THEN 'Schedule coaching session. Low QA score.' ELSE 'Monitor. Call requires periodic review.' END"""
MODES = """
md AS (SELECT call_id, sentiment FROM (SELECT call_id, sentiment, count(*) AS n, min(seg_idx) AS f FROM st GROUP BY call_id, sentiment)
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY n DESC, f) = 1),
ma AS (SELECT call_id, sentiment FROM (SELECT call_id, sentiment, count(*) AS n, min(seg_idx) AS f FROM st WHERE speaker = 'agent' GROUP BY call_id, sentiment)
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY n DESC, f) = 1)"""
SENTENCE = "CASE WHEN total_violations = 0 THEN 'No violations detected.' ELSE total_violations || ' violation(s) found (' || agent_violations || ' by agent).' END"
POINTS = "concat_ws('|', 'Customer sentiment: ' || md.sentiment, 'Agent tone: ' || ma.sentiment, 'QA Score: ' || qa_score || ' (' || grade || ')')"


@query(
    "ag11_crm_note",
    f"""WITH {SCORED}, {MODES} SELECT qa.call_id, {POINTS} AS key_points, {SENTENCE} AS compliance_summary, {ACTION} AS recommended_action, total_violations
    FROM qa LEFT JOIN md ON qa.call_id = md.call_id LEFT JOIN ma ON qa.call_id = ma.call_id""",
)
def ag11(spark, d):
    rows = scored_turns(spark, d)
    graded = scoring.grade_calls(scoring.component_scores(rows))
    out = notes.crm_notes(graded, rows)
    return out.select("call_id", F.array_join("key_points", "|").alias("key_points"), "compliance_summary", "recommended_action", "total_violations")


# Sentence breaks are marked first, because RE2 has no look-behind.
def summary_sql(source: str, prefix: str) -> str:
    body = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
    return rf"""
{prefix}s0 AS (SELECT call_id, list_filter(list_transform(string_split(regexp_replace({body}, '([.!?\x{{0964}}]){WS}+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: length(s) > 10) AS a,
  list_filter(list_transform(string_split({body}, chr(10)), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '') AS b FROM {source}),
{prefix}s1 AS (SELECT call_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS sents FROM {prefix}s0),
{prefix}s2 AS (SELECT call_id, len(sents) AS n, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS idx FROM {prefix}s1),
{prefix}s3 AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS toks FROM {prefix}s2),
{prefix}tf AS (SELECT call_id, idx, n, len(toks) AS len_, tok, count(*) AS tf FROM (SELECT *, unnest(toks) AS tok FROM {prefix}s3) GROUP BY ALL),
{prefix}df AS (SELECT call_id, tok, count(*) AS df FROM {prefix}tf GROUP BY call_id, tok),
{prefix}sc AS (SELECT t.call_id, t.idx, sum(tf / len_ * ln((n + 1) / (df + 1)) + 1) AS s FROM {prefix}tf t JOIN {prefix}df d ON t.call_id = d.call_id AND t.tok = d.tok GROUP BY t.call_id, t.idx),
{prefix}rk AS (SELECT s3.call_id, s3.idx, s3.sentence FROM {prefix}s3 s3 LEFT JOIN {prefix}sc sc ON s3.call_id = sc.call_id AND s3.idx = sc.idx
  QUALIFY row_number() OVER (PARTITION BY s3.call_id ORDER BY {rnd("coalesce(s, 0)", 9)} DESC, s3.idx) <= 5),
{prefix}sum AS (SELECT s.call_id, coalesce(string_agg(r.sentence, ' ' ORDER BY r.idx), {lit(notes.NO_TRANSCRIPT)}) AS summary
  FROM {prefix}s1 s LEFT JOIN {prefix}rk r ON s.call_id = r.call_id GROUP BY s.call_id)"""


@query("ag12_document_summary", f"WITH {DOC}, {summary_sql('doc', 'd')} SELECT call_id, summary FROM dsum")
def ag12(spark, d):
    return notes.summarize_documents(standins.documents(spark, d))


@query(
    "tk1_top_sentences",
    f"WITH {DOC}, {summary_sql('doc', 'd')} SELECT call_id, idx::BIGINT - 1 AS sent_idx FROM drk",
)
def tk1(spark, d):
    rows = notes.best_sentences(standins.documents(spark, d))
    return rows.select("call_id", F.explode(F.col("best").cast("array<long>")).alias("sent_idx"))


CALL_TEXT = "ct AS (SELECT call_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM seg GROUP BY call_id)"


@query("ag12_call_summary", f"WITH {SEG}, {CALL_TEXT}, {summary_sql('ct', 'c')} SELECT call_id, summary FROM csum")
def ag12c(spark, d):
    return notes.summarize_calls(standins.segments(spark, d))


@query(
    "fx17_note_text",
    f"""WITH {SCORED}, {MODES}, {CALL_TEXT}, {summary_sql("ct", "c")},
    fl AS (SELECT call_id, string_agg(category || ':' || keyword, '; ' ORDER BY rn) AS flags FROM (SELECT *, row_number() OVER (PARTITION BY call_id
      ORDER BY seg_idx, stage, pos, matched) AS rn FROM vio) WHERE rn <= 5 GROUP BY call_id),
    n AS (SELECT qa.*, md.sentiment AS mood, ma.sentiment AS tone, csum.summary || coalesce(' ' || chr(10) || 'Compliance flags: ' || fl.flags, '')
      || ' Overall customer sentiment: ' || md.sentiment AS s FROM qa JOIN csum ON qa.call_id = csum.call_id
      LEFT JOIN md ON qa.call_id = md.call_id LEFT JOIN ma ON qa.call_id = ma.call_id LEFT JOIN fl ON qa.call_id = fl.call_id)
    SELECT call_id, concat_ws(chr(10), 'Executive Summary: ' || s, '', 'Key Discussion Points:', '1. Customer sentiment: ' || mood,
      CASE WHEN tone IS NOT NULL THEN '2. Agent tone: ' || tone END,
      CASE WHEN tone IS NOT NULL THEN '3' ELSE '2' END || '. QA Score: ' || qa_score || ' (' || grade || ')', '', 'Compliance Overview: ' || {SENTENCE}, '',
      'Recommended Action: ' || {ACTION}) AS note_text FROM n""",
)
def fx17(spark, d):
    rows = materialize(scored_turns(spark, d), "scored")
    seg = rows.select("call_id", "seg_idx", "speaker", "text")
    graded = scoring.grade_calls(scoring.component_scores(rows))
    flags = compliance.first_flags(compliance.violations(seg, SEG_POLICY))
    return notes.note_as_text(notes.crm_notes(graded, rows, flags, notes.summarize_calls(seg)))


@query(
    "io11_result_documents",
    f"""WITH {SCORED} SELECT s.call_id, 0::BIGINT AS page, count(*) AS n_segments,
      string_agg(s.seg_idx || ':' || speaker || ':' || sentiment || ':' || v, ',' ORDER BY s.seg_idx) AS segments, first(qa_score) AS qa_score, first(grade) AS grade
    FROM st s JOIN qa ON s.call_id = qa.call_id GROUP BY s.call_id""",
)
def io11(spark, d):
    rows = scored_turns(spark, d)
    graded = scoring.grade_calls(scoring.component_scores(rows)).select("call_id", F.struct("qa_score", "grade").alias("qa"))
    docs = store.assemble(rows.select("call_id", "seg_idx", "speaker", "sentiment", "violation_count"), graded)
    line = lambda s: F.concat_ws(":", s["seg_idx"].cast("string"), s["speaker"], s["sentiment"], s["violation_count"].cast("string"))
    return docs.select(
        "call_id",
        "page",
        F.size("segments").cast("long").alias("n_segments"),
        F.array_join(F.transform("segments", line), ",").alias("segments"),
        "qa.qa_score",
        "qa.grade",
    )


# --- flagship ----------------------------------------------------------------------------------
FLAGSHIP_SQL = f"""WITH {SCORED}, {MODES} SELECT qa.call_id, n_turns, total_violations, agent_violations, customer_sentiment, compliance, agent_stability,
  intent_resolution, talk_ratio, qa_score, grade, {ACTION} AS recommended_action FROM qa"""


@query("worst_calls_and_why", FLAGSHIP_SQL)
def flagship(spark, d):
    """QA grade of every call with its components, violations and the action they call for."""
    graded = scoring.grade_calls(scoring.component_scores(scored_turns(spark, d)))
    action = notes.recommended_action(F.col("total_violations"), F.col("agent_violations"), F.col("grade"))
    return graded.select(
        "call_id",
        "n_turns",
        "total_violations",
        "agent_violations",
        *scoring.COMPONENTS,
        "qa_score",
        "grade",
        action.alias("recommended_action"),
    ).orderBy("qa_score", "call_id")


