"""Queries over turns and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import rules, text
from callweave.operators import align, roles, turns
from callweave.plans import standins
from callweave.plans.oracle import DIAR, DOC, NWS, SEG, SIG, WORDS, rnd, spaced, strip
from callweave.plans.registry import query

TEST_AGENT_PHRASES = r"(?:that\s+of|le\s+la|und\s+der|de\s+la)"


@query(
    "pf1_drop_blank_turns",
    f"""WITH t AS (
      SELECT conv_id AS call_id, turn AS seg_idx,
             CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' || text || ' ' ELSE text END AS text FROM conversations)
    SELECT call_id, seg_idx, {strip("text")} AS text FROM t WHERE regexp_matches(text, '{NWS}')""",
)
def pf1(spark, d):
    t = standins.table(spark, d, "conversations").select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("seg_idx"),
        F.when(F.col("turn") % 3 == 0, "")
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("  "), "text", F.lit(" ")))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    return turns.drop_blank(t)


@query(
    "pf2_transcript_search",
    f"""WITH {SEG} SELECT call_id, seg_idx, speaker FROM seg WHERE contains(lower(text), lower('THE TH'))""",
)
def pf2(spark, d):
    return standins.segments(spark, d).where(text.matches_query(F.col("text"), "THE TH")).select("call_id", "seg_idx", "speaker")


SHORT = "round(0.02::DOUBLE * nw, 3)"
MARGIN = "CASE WHEN length(text) % 7 = 0 THEN NULL ELSE (length(text) % 40 - 20) / 100.0::DOUBLE END"


def _short(spark, d):
    n = F.length("text")
    return standins.segments(spark, d).select(
        "call_id",
        "seg_idx",
        F.round(F.lit(0.02) * F.col("nw"), 3).alias("seconds"),
        F.when(n % 7 != 0, (n % 40 - 20) / 100.0).alias("margin"),
    )


@query(
    "pf3_duration_confidence",
    f"""WITH {SEG}, t AS (SELECT call_id, seg_idx, {SHORT} AS seconds FROM seg),
    c AS (SELECT call_id, seg_idx, CASE WHEN seconds >= 2 THEN 1.0 WHEN seconds >= 1 THEN 0.85 WHEN seconds >= 0.5 THEN 0.65
      WHEN seconds >= 0.3 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence FROM t)
    SELECT *, confidence < 0.5 AS uncertain FROM c""",
)
def pf3(spark, d):
    c = rules.duration_confidence(F.col("seconds"))
    return _short(spark, d).select("call_id", "seg_idx", c.alias("confidence"), (c < 0.5).alias("uncertain"))


@query(
    "pf4_short_turn_review",
    f"""WITH {SEG} SELECT call_id, seg_idx, {SHORT} < 0.5 AND abs(coalesce({MARGIN}, 0)) < 0.1 AS needs_review FROM seg""",
)
def pf4(spark, d):
    return _short(spark, d).select("call_id", "seg_idx", rules.needs_review(F.col("seconds"), F.col("margin")).alias("needs_review"))


@query(
    "pf6_script_routing",
    """SELECT lang, count(*) AS n_docs, sum(CASE WHEN regexp_matches(text, '[À-ÿ]') THEN 1 ELSE 0 END)::BIGINT AS n_routed,
       round(avg(CASE WHEN regexp_matches(text, '[À-ÿ]') THEN 1.0 ELSE 0.0 END), 6) AS share
       FROM documents GROUP BY lang""",
)
def pf6(spark, d):
    hit = text.needs_translation(F.col("text"), "[À-ÿ]")
    return (
        standins.table(spark, d, "documents")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.count_if(hit).alias("n_routed"),
            F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("share"),
        )
    )


@query(
    "pf7_scoring_text",
    f"""SELECT doc_id AS call_id, CASE WHEN regexp_matches(left(text, 512), '{NWS}') THEN {strip("left(text, 512)")} ELSE 'neutral' END
        AS scoring_text FROM documents""",
)
def pf7(spark, d):
    return standins.documents(spark, d).select("call_id", text.scoring_text(F.col("text")).alias("scoring_text"))


@query(
    "pf8_minimum_length",
    f"""WITH {SEG} SELECT call_id, seg_idx, {SHORT} < 0.3 AS too_short FROM seg""",
)
def pf8(spark, d):
    return _short(spark, d).select("call_id", "seg_idx", rules.too_short_to_judge(F.col("seconds")).alias("too_short"))


@query(
    "pf10_role_predicates",
    f"""WITH {SEG}, {DIAR}, b AS (SELECT 'roles' AS src, call_id, seg_idx, speaker FROM seg UNION ALL
      SELECT 'diarized', call_id, seg_idx, speaker FROM diar)
    SELECT src, call_id, seg_idx, contains(lower(speaker), 'agent') OR lower(speaker) = 'spk_0' AS is_agent,
      contains(lower(speaker), 'customer') OR lower(speaker) = 'spk_1' AS is_customer FROM b""",
)
def pf10(spark, d):
    cols = ["call_id", "seg_idx", "speaker"]
    both = (
        standins.segments(spark, d).select(F.lit("roles").alias("src"), *cols)
        .unionByName(standins.diarized(spark, d).select(F.lit("diarized").alias("src"), *cols))
    )
    return both.select(
        "src",
        "call_id",
        "seg_idx",
        rules.is_agent(F.col("speaker")).alias("is_agent"),
        rules.is_customer(F.col("speaker")).alias("is_customer"),
    )


@query(
    "jn1_word_alignment",
    f"""WITH {WORDS}, ov AS (
      SELECT w.call_id, w.word_idx, s.seg_idx, w.text, w.probability,
             least(w."end", s.end_time_s) - greatest(w.start, s.start_time_s) AS overlap
      FROM words w JOIN seg s ON w.call_id = s.call_id),
    best AS (SELECT * FROM ov WHERE overlap > 0
      QUALIFY row_number() OVER (PARTITION BY call_id, word_idx ORDER BY overlap DESC, seg_idx) = 1),
    agg AS (SELECT call_id, seg_idx, string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words,
      sum(probability) / count(*) AS p FROM best GROUP BY call_id, seg_idx)
    SELECT s.call_id, s.seg_idx, s.speaker, s.start_time_s, s.end_time_s, 0::BIGINT AS page,
      coalesce(trim(a.text), '') AS text, coalesce(a.n_words, 0) AS n_words,
      coalesce({rnd("a.p", 3)}, 0.0) AS avg_logprob
    FROM seg s LEFT JOIN agg a ON s.call_id = a.call_id AND s.seg_idx = a.seg_idx""",
)
def jn1(spark, d):
    seg = standins.segments(spark, d)
    out = align.turn_transcripts(align.align_words(standins.words(spark, d), seg), seg)
    return out.select("call_id", "seg_idx", "speaker", "start_time_s", "end_time_s", "page", "text", "n_words", "avg_logprob")


@query(
    "jn2_turns_in_regions",
    f"""WITH {SEG}, {DIAR}, r AS (SELECT call_id, start_time_s, end_time_s FROM diar WHERE speaker <> 'spk_0')
    SELECT call_id, seg_idx FROM seg s WHERE EXISTS (SELECT 1 FROM r WHERE r.call_id = s.call_id
      AND r.start_time_s <= (s.start_time_s + s.end_time_s) / 2 AND (s.start_time_s + s.end_time_s) / 2 <= r.end_time_s)""",
)
def jn2(spark, d):
    seg = standins.segments(spark, d)
    points = seg.select("call_id", "seg_idx", ((F.col("start_time_s") + F.col("end_time_s")) / 2).alias("at"))
    regions = standins.diarized(spark, d).where("speaker <> 'spk_0'").select(
        "call_id", F.col("start_time_s").alias("start_s"), F.col("end_time_s").alias("end_s")
    )
    return align.points_in_regions(points, regions, "at").select("call_id", "seg_idx")


@query(
    "jn2_active_turn_at_playhead",
    f"""WITH {SEG}, {DIAR}
    SELECT s.call_id, s.seg_idx AS mark, t.seg_idx FROM seg s JOIN diar t ON s.call_id = t.call_id
      AND t.start_time_s <= s.start_time_s + 1.0 AND s.start_time_s + 1.0 < t.end_time_s""",
)
def jn2b(spark, d):
    heads = standins.segments(spark, d).select(
        "call_id", F.col("seg_idx").alias("mark"), (F.col("start_time_s") + 1.0).alias("at")
    )
    return align.active_turns(heads, standins.diarized(spark, d), "at").select("call_id", "mark", "seg_idx")


def _heuristic_sql() -> str:
    return f"""cast_ AS (SELECT call_id, list_sort(list(DISTINCT speaker)) AS spk FROM diar WHERE speaker LIKE 'spk_%' GROUP BY call_id),
    early AS (SELECT * FROM diar QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) <= 12),
    said AS (SELECT call_id, speaker, string_agg(text, ' ' ORDER BY seg_idx) AS said FROM early
      WHERE speaker LIKE 'spk_%' AND text <> '' GROUP BY call_id, speaker),
    hit AS (SELECT call_id, min(speaker) AS hit FROM said WHERE regexp_matches(said, '(?i){spaced(TEST_AGENT_PHRASES)}') GROUP BY call_id),
    ag AS (SELECT c.call_id, spk, CASE WHEN len(spk) >= 2 THEN coalesce(hit, spk[1]) ELSE spk[1] END AS agent,
      CASE WHEN len(spk) >= 2 AND hit IS NOT NULL THEN 'heuristic' ELSE 'fallback' END AS method
      FROM cast_ c LEFT JOIN hit h ON c.call_id = h.call_id),
    ro AS (SELECT call_id, method, agent AS speaker, 'agent' AS role FROM ag UNION ALL
      SELECT call_id, method, list_filter(spk, lambda x: x <> agent)[1], 'customer' FROM ag WHERE len(spk) >= 2)"""


@query("wn11_role_heuristic", f"WITH {DIAR}, {_heuristic_sql()} SELECT call_id, method, speaker, role FROM ro")
def wn11(spark, d):
    return roles.role_heuristic(standins.diarized(spark, d), TEST_AGENT_PHRASES).select("call_id", "method", "speaker", "role")


@query(
    "jn4_apply_roles",
    f"""WITH {DIAR}, {_heuristic_sql()}
    SELECT d.call_id, d.seg_idx, coalesce(r.role, d.speaker) AS speaker FROM diar d LEFT JOIN ro r
      ON d.call_id = r.call_id AND d.speaker = r.speaker""",
)
def jn4(spark, d):
    t = standins.diarized(spark, d)
    return roles.apply_roles(t, roles.role_heuristic(t, TEST_AGENT_PHRASES)).select("call_id", "seg_idx", "speaker")


@query(
    "jn6_nearest_chunk",
    f"""WITH {DIAR}, g AS (SELECT call_id, max(end_time_s) AS dur, count(*) AS n FROM diar GROUP BY call_id),
    c AS (SELECT d.call_id, seg_idx, (start_time_s + end_time_s) / 2 AS centre, n, dur / n AS step FROM diar d JOIN g ON d.call_id = g.call_id),
    k AS (SELECT *, greatest(0, least(round_even((centre - 0.5) / step, 0)::BIGINT, n - 1)) AS chunk_idx FROM c)
    SELECT call_id, seg_idx, chunk_idx,
      greatest(0, least(trunc((centre - (0.5 + chunk_idx * step)) / 5.0 * 100)::BIGINT, 99)) AS frame_idx FROM k""",
)
def jn6(spark, d):
    t = standins.diarized(spark, d).select("call_id", "seg_idx", "start_time_s", "end_time_s")
    grid = t.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("end_time_s").alias("dur")).select(
        "call_id",
        F.lit(0.5).alias("chunk_start"),
        (F.col("dur") / F.col("n_chunks")).alias("chunk_step"),
        F.lit(5.0).alias("chunk_duration"),
        "n_chunks",
    )
    return align.nearest_chunk(t, grid, frames=100).select("call_id", "seg_idx", "chunk_idx", "frame_idx")


@query(
    "wn1_merge_adjacent",
    f"""WITH RECURSIVE {DIAR}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) AS rn FROM diar),
    m AS (
      SELECT call_id, rn, speaker, start_time_s AS s, end_time_s AS e, 0::BIGINT AS island FROM n WHERE rn = 1
      UNION ALL
      SELECT n.call_id, n.rn, n.speaker, n.start_time_s,
        CASE WHEN n.speaker = m.speaker AND n.start_time_s - m.e <= 0.5 THEN greatest(m.e, n.end_time_s) ELSE n.end_time_s END,
        CASE WHEN n.speaker = m.speaker AND n.start_time_s - m.e <= 0.5 THEN m.island ELSE m.island + 1 END
      FROM m JOIN n ON n.call_id = m.call_id AND n.rn = m.rn + 1)
    SELECT call_id, island AS seg_idx, min(speaker) AS speaker, min(s) AS start_time_s, max(e) AS end_time_s, count(*) AS n_turns
    FROM m GROUP BY call_id, island""",
)
def wn1(spark, d):
    out = turns.merge_adjacent(standins.diarized(spark, d))
    return out.select("call_id", "seg_idx", "speaker", "start_time_s", "end_time_s", "n_turns")


@query(
    "wn2_merge_false_splits",
    f"""WITH {DIAR}, t AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n, lag(speaker) OVER (PARTITION BY call_id ORDER BY seg_idx) AS p FROM diar),
    f AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> speaker OR n < 3 OR (length(text) % 100) / 100.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END)
      OVER (PARTITION BY call_id ORDER BY seg_idx) AS island FROM t)
    SELECT call_id, min(seg_idx) AS seg_idx, first(speaker ORDER BY seg_idx) AS speaker, first(start_time_s ORDER BY seg_idx) AS start_time_s,
      last(end_time_s ORDER BY seg_idx) AS end_time_s, count(*) AS n_turns FROM f GROUP BY call_id, island""",
)
def wn2(spark, d):
    t = standins.diarized(spark, d).withColumn("boundary_score", (F.length("text") % 100) / 100.0)
    return turns.merge_false_splits(t, 0.5).select("call_id", "seg_idx", "speaker", "start_time_s", "end_time_s", "n_turns")


@query(
    "wn10_role_context",
    f"""WITH {DIAR}, t AS (SELECT *, lower(trim(speaker)) AS who FROM diar WHERE nw >= 2
      QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) <= 12),
    f AS (SELECT call_id, who, row_number() OVER (PARTITION BY call_id ORDER BY min(seg_idx)) AS k FROM t GROUP BY call_id, who)
    SELECT t.call_id, string_agg('[SPK_' || chr((64 + k)::INT) || '] ' || {strip("text")}, ' ' ORDER BY seg_idx) AS context,
      count(*) AS turns_used FROM t JOIN f ON t.call_id = f.call_id AND t.who = f.who GROUP BY t.call_id""",
)
def wn10(spark, d):
    return roles.role_context(standins.diarized(spark, d))


@query(
    "wn14_turn_boundaries",
    f"""WITH {SIG}, s AS (SELECT call_id, ts, event_id, CASE WHEN event_type IN ('error', 'click') THEN 'A' ELSE 'B' END AS spk FROM fr0),
    l AS (SELECT *, lag(ts) OVER w AS p, lag(spk) OVER w AS q FROM s WINDOW w AS (PARTITION BY call_id ORDER BY ts, event_id)),
    f AS (SELECT *, sum(CASE WHEN p IS NULL OR q <> spk OR epoch_us(ts) - epoch_us(p) > 86400000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY call_id ORDER BY ts, event_id) AS turn_no FROM l)
    SELECT call_id, turn_no::BIGINT AS turn_no, min(spk) AS speaker, count(*) AS n_events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
    FROM f GROUP BY call_id, turn_no""",
)
def wn14(spark, d):
    ev = standins.table(spark, d, "events").select(
        F.col("user_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
        F.when(F.col("event_type").isin("error", "click"), "A").otherwise("B").alias("speaker"),
    )
    us = F.unix_micros("at")
    pause = us - F.unix_micros("prev_at") > 86_400_000_000
    out = turns.turn_boundaries(ev, ["call_id"], ["at", "event_id"], F.date_trunc("day", "at"), pause, "speaker")
    return out.groupBy("call_id", "turn_no").agg(
        F.min("speaker").alias("speaker"), F.count(F.lit(1)).alias("n_events"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


@query(
    "tk3_transcript_head",
    f"""WITH {SEG}, t AS (SELECT * FROM seg WHERE regexp_matches(text, '{NWS}')
      QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) <= 80)
    SELECT call_id, string_agg('[' || speaker || ']: ' || {strip("text")}, chr(10) ORDER BY seg_idx) AS transcript, count(*) AS n_lines
    FROM t GROUP BY call_id""",
)
def tk3(spark, d):
    return roles.transcript_head(standins.segments(spark, d))


@query(
    "so2_distinct_speakers",
    f"""WITH {DIAR} SELECT call_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM diar
        WHERE speaker <> '' GROUP BY call_id""",
)
def so2(spark, d):
    return roles.speakers_of(standins.diarized(spark, d)).select("call_id", F.array_join("speakers", ",").alias("speakers"))


@query(
    "so4_speakers_in_both",
    f"""WITH {DIAR}, m AS (SELECT call_id, 'spk_' || (call_id % 3) AS speaker FROM diar)
    SELECT call_id, speaker FROM m INTERSECT SELECT call_id, speaker FROM diar""",
)
def so4(spark, d):
    t = standins.diarized(spark, d)
    mapping = t.select("call_id", F.concat(F.lit("spk_"), F.col("call_id") % 3).alias("speaker"))
    return roles.speakers_in_both(mapping, t)


@query(
    "ag31_single_speaker_collapse",
    f"""WITH {DIAR}, f AS (SELECT call_id, count(*) FILTER (speaker = 'spk_0') > count(*) * 0.6 AS is_single FROM diar GROUP BY call_id)
    SELECT d.call_id, seg_idx, speaker, start_time_s, end_time_s FROM diar d JOIN f ON d.call_id = f.call_id WHERE NOT is_single
    UNION ALL
    SELECT d.call_id, min(seg_idx), 'spk_0', first(start_time_s ORDER BY seg_idx), last(end_time_s ORDER BY seg_idx)
    FROM diar d JOIN f ON d.call_id = f.call_id WHERE is_single GROUP BY d.call_id""",
)
def ag31(spark, d):
    t = standins.diarized(spark, d)
    flags = t.groupBy("call_id").agg((F.count_if(F.col("speaker") == "spk_0") > F.count(F.lit(1)) * 0.6).alias("is_single"))
    return turns.collapse_single_speaker(t, flags)


@query(
    "fx6_tokenizers",
    rf"""WITH {DOC} SELECT call_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS n_tokens,
      len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]+')) AS n_tokens_marks,
      coalesce(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')).len(), 0) AS n_distinct FROM doc""",
)
def fx6(spark, d):
    t = text.tokens(F.col("text"))
    return standins.documents(spark, d).select(
        "call_id",
        F.size(t).cast("long").alias("n_tokens"),
        F.size(text.tokens_with_marks(F.col("text"))).cast("long").alias("n_tokens_marks"),
        F.size(F.array_distinct(t)).cast("long").alias("n_distinct"),
    )


@query(
    "wn_row_index",
    f"WITH {SIG} SELECT call_id, event_id, frame_idx FROM fr",
)
def row_index(spark, d):
    return standins.frames(spark, d).select("call_id", "event_id", "frame_idx")


@query(
    "fx13_clock_times",
    """WITH t AS (SELECT event_id, event_id % 5 AS k, (value * 100)::BIGINT AS c, user_id % 60 AS m FROM events),
    s AS (SELECT event_id, k, c, m, CASE k WHEN 0 THEN '' || (c // 100) WHEN 1 THEN m || ':' || (c % 60)
      WHEN 2 THEN '0:' || m || ':' || (c % 100) WHEN 3 THEN (1 + m % 9) || ' : ' || (c % 60) || ':' || (c % 100)
      ELSE (10 + m % 9) || ':' || (c % 60) || ':' || (c % 50) END AS stamp FROM t)
    SELECT event_id, stamp, CASE k WHEN 0 THEN (c // 100)::DOUBLE WHEN 1 THEN m * 60.0::DOUBLE + c % 60
      WHEN 2 THEN round(m + (c % 100) / 100.0::DOUBLE, 6) WHEN 3 THEN round((1 + m % 9) * 60.0::DOUBLE + c % 60 + (c % 100) / 100.0::DOUBLE, 6)
      ELSE (10 + m % 9) * 3600.0::DOUBLE + (c % 60) * 60.0 + c % 50 END::DOUBLE AS seconds FROM s""",
)
def fx13(spark, d):
    k, c, m = F.col("event_id") % 5, F.round(F.col("value") * 100).cast("long"), F.col("user_id") % 60
    sep = F.lit(":")
    stamp = (
        F.when(k == 0, F.floor(c / 100).cast("string"))
        .when(k == 1, F.concat(m, sep, c % 60))
        .when(k == 2, F.concat(F.lit("0:"), m, sep, c % 100))
        .when(k == 3, F.concat(m % 9 + 1, F.lit(" : "), c % 60, sep, c % 100))
        .otherwise(F.concat(m % 9 + 10, sep, c % 60, sep, c % 50))
    )
    rows = standins.table(spark, d, "events").select("event_id", stamp.alias("stamp"))
    return rows.withColumn("seconds", F.round(text.clock_seconds(F.col("stamp")), 6))


@query(
    "fx14_job_ids",
    r"""SELECT doc_id, 'call-' || regexp_replace(source || '/' || lang || ' ' || doc_id || '.wav', '[^A-Za-z0-9_-]', '_', 'g') AS job_id FROM documents""",
)
def fx14(spark, d):
    name = F.concat("source", F.lit("/"), "lang", F.lit(" "), "doc_id", F.lit(".wav"))
    return standins.table(spark, d, "documents").select("doc_id", text.job_id(name).alias("job_id"))


