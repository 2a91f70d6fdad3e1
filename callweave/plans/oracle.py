"""SQL building blocks: the stand-in views written for DuckDB."""

from __future__ import annotations

from callweave.functions.lexicon import JOB_STAGES

# The same white-space class as functions.text.SPACE.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = WS.replace("[", "[^", 1)


def rnd(expr: str, digits: int) -> str:
    """Round half up after dropping noise below 1e-10."""
    return f"round(round({expr}, 10)::DECIMAL(38,10), {digits})::DOUBLE"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def spaced(pattern: str) -> str:
    """A pattern whose white space is that of Unicode."""
    return pattern.replace(r"\s", WS)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def case_map(table: dict[str, str], expr: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {lit(otherwise)} END"


SEG = r"""
seg0 AS (
  SELECT conv_id AS call_id, turn AS seg_idx,
         CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE 'overlap' END AS speaker,
         text, len(regexp_split_to_array(text, '\s+')) AS nw
  FROM conversations),
seg1 AS (SELECT *, sum(nw) OVER (PARTITION BY call_id ORDER BY seg_idx) AS cw FROM seg0),
seg AS (
  SELECT call_id, seg_idx, speaker, text, nw, round(0.4::DOUBLE * (cw - nw)::DOUBLE, 3) AS start_time_s,
         round(0.4::DOUBLE * cw::DOUBLE, 3) AS end_time_s, round(0.4::DOUBLE * nw, 3) AS duration_s
  FROM seg1)"""

DIAR = r"""
dz0 AS (
  SELECT conv_id AS call_id, turn AS seg_idx,
         CASE WHEN role = 'system' THEN 'overlap' ELSE 'spk_' || (length(text) % 2) END AS speaker, text,
         len(regexp_split_to_array(text, '\s+')) AS nw, length(text) % 4 AS pause,
         CASE WHEN length(text) % 5 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS extra
  FROM conversations),
dz1 AS (
  SELECT *, sum(nw) OVER w AS cw, sum(pause) OVER w AS cp FROM dz0
  WINDOW w AS (PARTITION BY call_id ORDER BY seg_idx)),
dz2 AS (
  SELECT *, round(0.4::DOUBLE * (cw - nw)::DOUBLE + 0.3::DOUBLE * cp::DOUBLE, 3) AS start_time_s FROM dz1),
dz3 AS (SELECT *, round(start_time_s + 0.4::DOUBLE * nw + extra, 3) AS end_time_s FROM dz2),
diar AS (
  SELECT call_id, seg_idx, speaker, text, nw, start_time_s, end_time_s,
         round(end_time_s - start_time_s, 3) AS duration_s FROM dz3)"""

WORDS = (
    SEG
    + r""",
w0 AS (
  SELECT call_id, seg_idx, start_time_s, unnest(regexp_split_to_array(text, '\s+')) AS text,
         generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS pos FROM seg),
w1 AS (
  SELECT *, round(start_time_s + 0.4::DOUBLE * pos + (length(text) % 5 - 2) * 0.15::DOUBLE, 3) AS start FROM w0),
words AS (
  SELECT call_id, seg_idx * 1000000 + pos AS word_idx, start, round(start + 0.4::DOUBLE, 3) AS "end", text,
         (length(text) * 7 % 50 + 50) / 100.0::DOUBLE AS probability FROM w1)"""
)

EMO = """
emo AS (
  SELECT *, ['anger', 'disgust', 'fear', 'joy', 'neutral', 'sadness', 'surprise'][length(text) % 7 + 1] AS label,
         (length(text) % 100) / 100.0::DOUBLE AS confidence,
         ['anger', 'sad', 'joy', 'fear', 'neutral', 'disgusted', 'surprised', 'annoyed'][length(text) * 3 % 8 + 1] AS tone,
         (length(text) * 37 % 100) / 100.0::DOUBLE AS tone_confidence,
         length(text) % 3 = 0 AS tone_indeterminate
  FROM seg)"""

EMB = """
emb AS (
  SELECT vec_id // 50 AS call_id, vec_id % 50 AS seg_idx, 'spk_' || (label % 2) AS speaker, label::BIGINT AS label,
         round(vec_id % 50 * 1.5::DOUBLE, 3) AS start_time_s,
         round(round(vec_id % 50 * 1.5::DOUBLE, 3) + 1.0 + label * 0.2::DOUBLE, 3) AS end_time_s,
         round(1.0 + label * 0.2::DOUBLE, 3) AS duration_s, embedding::DOUBLE[] AS embedding
  FROM embeddings)"""

SIG = """
fr0 AS (
  SELECT user_id AS call_id, ts, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events),
fr AS (
  SELECT call_id, frame_idx, event_id, event_type, value, frame_idx // 20 AS seg_idx,
         CASE WHEN frame_idx % 20 < 6 AND call_id % 3 <> 0 THEN 1e-6 ELSE value * value END::DOUBLE AS energy,
         value / 100.0::DOUBLE AS rms,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE 80.0 + value END::DOUBLE AS pitch_hz,
         (value * 7 % 50)::DOUBLE AS zcr, value AS level
  FROM fr0)"""

EVT = f"""
evt AS (
  SELECT user_id::VARCHAR AS filename, {JOB_STAGES!r}[event_id % 9 + 1] AS stage_id,
         CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'created' ELSE 'done' END
              WHEN event_type = 'view' THEN 'running' WHEN event_type = 'click' THEN 'done'
              WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'error' END
              ELSE CASE WHEN event_id % 3 = 0 THEN 'finished' ELSE 'running' END END AS status,
         value AS time_s, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'E' || event_id END AS error, ts AS event_time, event_id AS seq
  FROM events)"""

DOC = """
doc AS (
  SELECT doc_id AS call_id, 0::BIGINT AS seg_idx, CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS speaker,
         text FROM documents)"""


def grade_case(expr: str) -> str:
    return f"CASE WHEN {expr} >= 85 THEN 'A' WHEN {expr} >= 70 THEN 'B' WHEN {expr} >= 55 THEN 'C' ELSE 'D' END"


def violations_cte(source: str, policy, name: str = "vio") -> str:
    """CTEs ending in ``name``: everything a policy without compound phrases finds in ``source``."""
    words = list(dict.fromkeys(policy.keywords))
    keywords = values([(i, w) for i, w in enumerate(words)], "pos, kw")
    innocent = ", ".join(lit(w) for w in policy.innocent) or "''"
    parts = []
    for i, p in enumerate(policy.threats):
        parts.append((i, "THREAT", "threat", 2, p))
    for r, (regulator, patterns) in enumerate(policy.regulatory.items()):
        first = sum(len(ps) for ps in list(policy.regulatory.values())[:r])
        parts += [(first + i, regulator, "pattern", 4, p) for i, p in enumerate(patterns)]
    pattern_rows = " UNION ALL ".join(
        f"SELECT call_id, seg_idx, speaker, {lit(c)} AS category, regexp_extract(text, {lit(spaced(p))}) AS keyword, "
        f"{lit(t)} AS match_type, 0 AS distance, {stage} AS stage, {pos} AS pos FROM {source} WHERE regexp_matches(text, {lit(spaced(p))})"
        for pos, c, t, stage, p in parts
    )
    return f"""
{name}_kw AS {keywords},
{name}_exact AS (SELECT s.call_id, s.seg_idx, s.speaker, kw, pos FROM {source} s JOIN {name}_kw ON contains(lower(s.text), kw)),
{name}_pat0 AS ({pattern_rows}),
{name}_pat AS (SELECT * FROM {name}_pat0 p WHERE stage <> 2 OR (
  NOT EXISTS (SELECT 1 FROM {name}_exact e WHERE e.call_id = p.call_id AND e.seg_idx = p.seg_idx AND e.kw = p.keyword)
  AND NOT EXISTS (SELECT 1 FROM {name}_pat0 q WHERE q.call_id = p.call_id AND q.seg_idx = p.seg_idx AND q.stage = 2
    AND q.keyword = p.keyword AND q.pos < p.pos))),
{name}_tk AS (SELECT call_id, seg_idx, speaker, tok, list_position(toks, tok) AS pos FROM (
    SELECT *, unnest(list_distinct(toks)) AS tok FROM (
      SELECT call_id, seg_idx, speaker, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]+') AS toks FROM {source}))
  WHERE length(tok) >= 5 AND tok NOT IN ({innocent})),
{name}_voc AS (SELECT DISTINCT tok FROM {name}_tk),
{name}_near0 AS (SELECT tok, kw, k.pos AS dict_pos, levenshtein(tok, kw) AS d,
    CASE WHEN length(tok) < 6 THEN 1 ELSE {policy.max_distance} END AS allowed
  FROM {name}_voc JOIN {name}_kw k ON abs(length(tok) - length(kw)) <= CASE WHEN length(tok) < 6 THEN 1 ELSE {policy.max_distance} END
  WHERE tok NOT IN (SELECT kw FROM {name}_kw)),
{name}_near AS (SELECT tok, arg_min(kw, dict_pos) AS kw, arg_min(d, dict_pos) AS d FROM {name}_near0 WHERE d BETWEEN 1 AND allowed GROUP BY tok),
{name} AS (
  SELECT call_id, seg_idx, speaker, 'ABUSIVE' AS category, kw AS keyword, kw AS matched, 'exact' AS match_type, 0::BIGINT AS distance, 0 AS stage, pos FROM {name}_exact
  UNION ALL SELECT call_id, seg_idx, speaker, category, keyword, keyword, match_type, distance, stage, pos FROM {name}_pat
  UNION ALL SELECT t.call_id, t.seg_idx, t.speaker, 'ABUSIVE', n.kw, t.tok, 'fuzzy', n.d, 3, t.pos FROM {name}_tk t JOIN {name}_near n ON t.tok = n.tok
    WHERE NOT EXISTS (SELECT 1 FROM {name}_pat p WHERE p.call_id = t.call_id AND p.seg_idx = t.seg_idx AND p.stage = 2 AND p.keyword = t.tok))"""
