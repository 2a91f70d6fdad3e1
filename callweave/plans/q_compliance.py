"""Queries over policy scanning."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import rules
from callweave.functions.lexicon import PATTERN_HINTS
from callweave.operators import compliance, evaluate, verdicts
from callweave.operators.compliance import DEFAULT_POLICY, Policy
from callweave.functions.text import swapped
from callweave.plans import standins
from callweave.plans.oracle import DOC, SEG, lit, rnd, spaced, violations_cte
from callweave.plans.registry import query
from callweave.session import materialize

# Patterns that occur in the test tables, next to the fixed regulatory lists.
CONTACT_PATTERNS = [
    r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}",
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    r"[0-9a-f]{40}",
    r"(?i)[a-z0-9._-]+@[a-z0-9.-]+",
    r"(?i)licen[cs]e",
]
DOC_POLICY = DEFAULT_POLICY.with_regulatory(CONTACT=CONTACT_PATTERNS)
# What any match of these must contain, so that the expressions run on few texts.
PATTERN_HINTS.update({CONTACT_PATTERNS[3]: ["@"], CONTACT_PATTERNS[4]: ["licen"]})
# Words of the test conversations, so that turns have something to find.
SEG_POLICY = Policy(
    keywords=(*DEFAULT_POLICY.keywords, "thing", "nicht", "unden"),
    innocent=(*DEFAULT_POLICY.innocent, "inthing", "thinged", "handen"),
    compounds=(),
    regulatory={**DEFAULT_POLICY.regulatory, "CONTACT": CONTACT_PATTERNS},
)
DOC_VIO = f"{DOC}, {violations_cte('doc', DOC_POLICY)}"
SEG_VIO = f"{SEG}, {violations_cte('seg', SEG_POLICY)}"
COLS = "call_id, seg_idx, speaker, category, keyword, matched, match_type, distance"


@query("fx2_regulatory_patterns", f"WITH {DOC_VIO} SELECT call_id, category, matched FROM vio WHERE match_type = 'pattern'")
def fx2(spark, d):
    scanned = compliance.scan_columns(standins.documents(spark, d), DOC_POLICY)
    return (
        compliance.direct_violations(scanned, DOC_POLICY).where("match_type = 'pattern'").select("call_id", "category", "matched")
    )


@query("fx3_keyword_hits", f"WITH {DOC_VIO} SELECT call_id, keyword FROM vio WHERE match_type = 'exact'")
def fx3(spark, d):
    scanned = compliance.scan_columns(standins.documents(spark, d), DOC_POLICY)
    found = compliance.direct_violations(scanned, DOC_POLICY)
    return found.where("match_type = 'exact'").select("call_id", "keyword")


@query("fx4_threat_patterns", f"WITH {DOC_VIO} SELECT call_id, matched FROM vio WHERE match_type = 'threat'")
def fx4(spark, d):
    scanned = compliance.scan_columns(standins.documents(spark, d), DOC_POLICY)
    found = compliance.direct_violations(scanned, DOC_POLICY)
    return found.where("match_type = 'threat'").select("call_id", "matched")


COMPOUND_POLICY = Policy(
    keywords=("the", "and"), compounds=(r"of\s+[a-z]+", r"[a-z]+\s+of\s+[a-z]+", r"with\s+[a-z]+"), threats=(), regulatory={}
)


def compound_sql(text: str) -> str:
    """The three compound phrases over the documents with ``text`` as their text."""
    one, two, three = (lit(spaced(p)) for p in COMPOUND_POLICY.compounds)
    return f"""WITH {DOC}, m AS (SELECT call_id, list_filter(['the', 'and'], lambda k: contains(lower(x), k)) AS seen,
      regexp_extract(x, {one}) AS m1, regexp_extract(x, {two}) AS m2, regexp_extract(x, {three}) AS m3 FROM (SELECT call_id, {text} AS x FROM doc)),
    k1 AS (SELECT *, m1 <> '' AND len(list_filter(seen, lambda s: contains(s, m1) OR contains(m1, s))) = 0 AS a FROM m),
    k2 AS (SELECT *, m2 <> '' AND len(list_filter(seen, lambda s: contains(s, m2) OR contains(m2, s))) = 0
      AND NOT (a AND (contains(m1, m2) OR contains(m2, m1))) AS b FROM k1),
    k3 AS (SELECT *, m3 <> '' AND len(list_filter(seen, lambda s: contains(s, m3) OR contains(m3, s))) = 0
      AND NOT (a AND (contains(m1, m3) OR contains(m3, m1))) AND NOT (b AND (contains(m2, m3) OR contains(m3, m2))) AS c FROM k2)
    SELECT call_id, m1 AS matched FROM k3 WHERE a UNION ALL SELECT call_id, m2 FROM k3 WHERE b UNION ALL SELECT call_id, m3 FROM k3 WHERE c"""


@query("fx4_compound_phrases", compound_sql("text"))
def fx4c(spark, d):
    scanned = compliance.scan_columns(standins.documents(spark, d), COMPOUND_POLICY)
    return scanned.select("call_id", F.explode("compound").alias("matched"))


@query("fx4_unicode_space", compound_sql("translate(text, ' ', chr(160))"))
def fx4u(spark, d):
    """The same where every space is a no-break space."""
    docs = standins.documents(spark, d).withColumn("text", swapped(F.col("text"), {" ": "\u00a0"}))
    return compliance.scan_columns(docs, COMPOUND_POLICY).select("call_id", F.explode("compound").alias("matched"))


@query(
    "fx5_edit_distance",
    r"""WITH w AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part) SELECT a, b, levenshtein(a, b) AS distance FROM w""",
)
def fx5(spark, d):
    pairs = standins.table(spark, d, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b").cast("long"))


@query("jn8_near_misses", f"WITH {DOC_VIO} SELECT call_id, keyword, matched, distance FROM vio WHERE match_type = 'fuzzy'")
def jn8(spark, d):
    return compliance.near_misses(standins.documents(spark, d), DOC_POLICY).select("call_id", "keyword", "matched", "distance")


@query("jn9_innocent_words", f"WITH {SEG_VIO} SELECT DISTINCT matched, keyword, distance FROM vio WHERE match_type = 'fuzzy'")
def jn9(spark, d):
    return compliance.near_misses(standins.segments(spark, d), SEG_POLICY).select("matched", "keyword", "distance").distinct()


@query("so1_all_violations", f"WITH {DOC_VIO} SELECT {COLS} FROM vio")
def so1(spark, d):
    return compliance.violations(standins.documents(spark, d), DOC_POLICY).select(*COLS.split(", "))


@query(
    "so1_turn_flags",
    f"""WITH {SEG_VIO}, f AS (SELECT call_id, seg_idx, count(*) AS n, string_agg(category || ':' || keyword, '|' ORDER BY stage, pos) AS flags
      FROM vio GROUP BY call_id, seg_idx)
    SELECT s.call_id, s.seg_idx, coalesce(n, 0) AS violation_count, coalesce(flags, '') AS flags FROM seg s
      LEFT JOIN f ON s.call_id = f.call_id AND s.seg_idx = f.seg_idx""",
)
def so1f(spark, d):
    seg = standins.segments(spark, d)
    out = compliance.turn_flags(seg, compliance.violations(seg, SEG_POLICY))
    return out.select("call_id", "seg_idx", "violation_count", F.array_join("flags", "|").alias("flags"))


@query(
    "so1_first_of_kind",
    f"""WITH {DOC_VIO} SELECT {COLS} FROM vio
    QUALIFY row_number() OVER (PARTITION BY call_id, seg_idx, matched ORDER BY stage, pos) = 1""",
)
def so1k(spark, d):
    found = compliance.violations(standins.documents(spark, d), DOC_POLICY)
    return compliance.first_of_kind(found).select(*COLS.split(", "))


@query(
    "tk4_first_flags",
    f"""WITH {SEG_VIO}, t AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx, stage, pos, matched) AS rn FROM vio)
    SELECT call_id, string_agg(category || ':' || keyword, '; ' ORDER BY rn) AS flags FROM t WHERE rn <= 5 GROUP BY call_id""",
)
def tk4(spark, d):
    found = compliance.violations(standins.segments(spark, d), SEG_POLICY)
    return compliance.first_flags(found).select("call_id", F.array_join("flags", "; ").alias("flags"))


@query(
    "ag3_compliance_totals",
    f"""WITH {DOC_VIO}, c AS (SELECT call_id, speaker, count(*) AS n FROM vio GROUP BY call_id, speaker)
    SELECT d.call_id, coalesce(sum(n), 0)::BIGINT AS total_violations,
      coalesce(sum(CASE WHEN contains(c.speaker, 'agent') THEN n ELSE 0 END), 0)::BIGINT AS agent_violations,
      coalesce(sum(CASE WHEN contains(c.speaker, 'agent') THEN 0 ELSE n END), 0)::BIGINT AS customer_violations,
      coalesce(sum(n), 0) = 0 AS compliant
    FROM doc d LEFT JOIN c ON d.call_id = c.call_id GROUP BY d.call_id""",
)
def ag3(spark, d):
    docs = standins.documents(spark, d)
    return compliance.violation_totals(compliance.violations(docs, DOC_POLICY), docs)


@query(
    "pf11_flag_parts",
    """WITH f AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'rbi' ELSE
        CASE event_type WHEN 'error' THEN 'threat' WHEN 'click' THEN 'ABUSIVE' ELSE 'irdai' END || ':' || props END AS flag FROM events),
    p AS (SELECT event_id, flag, upper(split_part(flag, ':', 1)) AS category FROM f)
    SELECT event_id, category, CASE WHEN contains(flag, ':') THEN substr(flag, instr(flag, ':') + 1) ELSE flag END AS detail,
      CASE category WHEN 'THREAT' THEN 'critical' WHEN 'ABUSIVE' THEN 'warn' ELSE 'info' END AS severity FROM p""",
)
def pf11(spark, d):
    kind = F.when(F.col("event_type") == "error", "threat").when(F.col("event_type") == "click", "ABUSIVE").otherwise("irdai")
    flags = standins.table(spark, d, "events").select(
        "event_id",
        F.array(F.when(F.col("event_id") % 10 == 0, "rbi").otherwise(F.concat(kind, F.lit(":"), "props"))).alias("flags"),
    )
    rows = flags.select("event_id", F.explode("flags").alias("flag"))
    cat = rules.flag_category(F.col("flag"))
    return rows.select(
        "event_id", cat.alias("category"), rules.flag_detail(F.col("flag")).alias("detail"), rules.flag_severity(cat).alias("severity")
    )


PAIRS_SQL = f"""pr AS (SELECT call_id // 2 AS call_id, call_id % 2 AS seg_idx, speaker, call_id AS doc_id FROM doc),
    kc AS (SELECT p.call_id, p.seg_idx, p.speaker, p.doc_id, coalesce(n, 0) AS n, coalesce(flags, '') AS flags FROM pr p LEFT JOIN (
      SELECT call_id AS doc_id, count(*) AS n, string_agg(category || ':' || keyword, '|' ORDER BY stage, pos) AS flags FROM vio GROUP BY call_id) v
      ON p.doc_id = v.doc_id),
    rv AS (SELECT k.*, l.toxic AS review, count(*) OVER (PARTITION BY call_id) AS n_turns, count(l.toxic) OVER (PARTITION BY call_id) AS n_rev
      FROM kc k LEFT JOIN labels l ON k.doc_id = l.doc_id)"""


@query(
    "jn11_review_merge",
    f"""WITH {DOC_VIO}, {PAIRS_SQL},
    s AS (SELECT *, CASE WHEN n_turns = n_rev AND review > 0 THEN 'reviewer' WHEN n_turns = n_rev AND review = 0 AND n > 0 THEN 'suppressed'
      ELSE 'keyword' END AS source FROM rv)
    SELECT call_id, seg_idx, source, (CASE source WHEN 'reviewer' THEN review WHEN 'suppressed' THEN 0 ELSE n END)::BIGINT AS violation_count,
      CASE WHEN source = 'suppressed' THEN flags ELSE '' END AS suppressed FROM s""",
)
def jn11(spark, d):
    docs = standins.documents(spark, d)
    flagged = compliance.turn_flags(docs, compliance.violations(docs, DOC_POLICY))
    half = [F.floor(F.col("call_id") / 2).alias("call_id"), (F.col("call_id") % 2).alias("seg_idx")]
    # The merge reads them twice; the texts are to be scanned once.
    counted = materialize(flagged.select(*half, "speaker", "violation_count", "flags"), "flagged")
    reviews = (
        standins.table(spark, d, "labels")
        .select(F.col("doc_id").alias("call_id"), F.col("toxic").cast("long").alias("review_count"))
        .select(*half, "review_count")
    )
    out = compliance.merge_reviews(counted, reviews)
    return out.select("call_id", "seg_idx", "source", "violation_count", F.array_join("suppressed", "|").alias("suppressed"))


@query(
    "ud1_scan_precision_recall",
    f"""WITH {DOC_VIO}, h AS (SELECT DISTINCT call_id FROM vio WHERE match_type = 'exact'),
    b AS (SELECT l.toxic = 1 AS bad, h.call_id IS NOT NULL AS hit FROM labels l LEFT JOIN h ON l.doc_id = h.call_id),
    c AS (SELECT count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn FROM b)
    SELECT tp, fp, fn, {rnd("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", 4)} AS precision,
      {rnd("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END", 4)} AS recall FROM c""",
)
def precision_recall(spark, d):
    scanned = compliance.scan_columns(standins.documents(spark, d), DOC_POLICY)
    found = compliance.direct_violations(scanned, DOC_POLICY).where("match_type = 'exact'")
    truth = standins.table(spark, d, "labels").select(F.col("doc_id").alias("call_id"), "toxic")
    return evaluate.scan_quality(found, truth)


# --- answers as JSON ---------------------------------------------------------------------------
# A reviewer's answer per user, built from that user's events: whole, fenced, cut off, or broken.
def _answers(spark, d):
    ev = standins.table(spark, d, "events").select(
        F.col("user_id").alias("call_id"),
        F.floor(F.col("event_id") / 1).alias("event_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_type",
    )
    kind = F.when(F.col("event_type") == "error", "abusive").when(F.col("event_type") == "click", "rbi").when(
        F.col("event_type") == "view", "irdai"
    ).otherwise("other")
    first = ev.groupBy("call_id").agg(F.min(F.struct("event_id", "k", kind.alias("kind"))).alias("e"))
    body = F.concat(
        F.lit('[{"index":0,"violations":[{"type":"'), F.col("e.kind"), F.lit('","keyword":"k'), F.col("e.k"),
        F.lit('","context_note":"n"}],"compliant":false},{"index":1,"violations":[]}'),
    )
    form = F.col("call_id") % 5
    raw = (
        F.when(form == 0, F.concat(body, F.lit("]")))
        .when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("]\n```")))
        .when(form == 2, F.concat(body, F.lit(',{"index":2,"viol')))
        .when(form == 3, F.lit("no answer"))
        .otherwise(F.lit('{"index":0}'))
    )
    return first.select("call_id", raw.alias("raw"), "e")


@query(
    "fx9_verdict_json",
    """WITH e AS (SELECT user_id AS call_id, event_type, json_extract_string(props, '$.k') AS k FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
    v AS (SELECT call_id, CASE event_type WHEN 'error' THEN 'ABUSIVE:k' || k WHEN 'click' THEN 'RBI:k' || k WHEN 'view' THEN 'IRDAI:k' || k ELSE '' END AS f,
      call_id % 5 < 3 AS ok FROM e)
    SELECT call_id, i::BIGINT AS seg_idx, CASE WHEN ok AND i = 0 THEN f ELSE '' END AS flags,
      (CASE WHEN ok AND i = 0 AND f <> '' THEN 1 ELSE 0 END)::BIGINT AS violation_count, NOT (ok AND i = 0) AS compliant
    FROM v, (VALUES (0), (1), (2)) AS t(i)""",
)
def fx9(spark, d):
    answers = _answers(spark, d)
    turns = answers.select("call_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("seg_idx")).withColumn(
        "speaker", F.lit("agent")
    )
    out = verdicts.verdicts_per_turn(turns, answers)
    return out.select("call_id", "seg_idx", F.array_join("flags", "|").alias("flags"), "violation_count", "compliant")


AUDIT_SQL = f"""{SEG}, au AS (SELECT call_id, min(length(text)) AS n FROM seg GROUP BY call_id)"""


def _audits(spark, d):
    """One combined answer per conversation; every fourth lacks a part and some are not JSON."""
    per = standins.segments(spark, d).groupBy("call_id").agg(F.min(F.length("text")).alias("n"))
    full = F.concat(
        F.lit('{"compliance":{"segment_results":[{"index":0,"flags":["RBI:x"],"violation_count":1},{"index":'),
        (F.col("n") % 9).cast("string"),
        F.lit(',"flags":[],"violation_count":0}]},"qa":{"qa_score":'),
        (F.col("n") % 100).cast("string"),
        F.lit('.5,"grade":"B"}'),
    )
    raw = (
        F.when(F.col("n") % 4 == 0, F.concat(full, F.lit("}")))
        .when(F.col("n") % 4 == 1, F.lit("sorry"))
        .otherwise(F.concat(full, F.lit(',"crm_note":{"summary":"s"}}')))
    )
    return per.select("call_id", raw.alias("raw"))


@query(
    "fx10_audit_json",
    f"""WITH {AUDIT_SQL} SELECT call_id, n % 4 >= 2 AS accepted, CASE WHEN n % 4 >= 2 THEN (n % 100) + 0.5 END::DOUBLE AS qa_score FROM au""",
)
def fx10(spark, d):
    out = verdicts.parse_audit(_audits(spark, d))
    return out.select("call_id", F.col("audit").isNotNull().alias("accepted"), "audit.qa.qa_score")


@query(
    "jn5_audit_turn_times",
    f"""WITH {AUDIT_SQL}, r AS (SELECT call_id, 0 AS seg_idx, 1::BIGINT AS violation_count FROM au WHERE n % 4 >= 2
      UNION ALL SELECT call_id, n % 9, 0 FROM au WHERE n % 4 >= 2)
    SELECT r.call_id, r.seg_idx::BIGINT AS seg_idx, r.violation_count, start_time_s, end_time_s FROM r JOIN seg s ON r.call_id = s.call_id AND r.seg_idx = s.seg_idx""",
)
def jn5(spark, d):
    audits = verdicts.parse_audit(_audits(spark, d)).where("audit is not null")
    out = verdicts.audit_turn_times(audits, standins.segments(spark, d))
    return out.select("call_id", "seg_idx", "violation_count", "start_time_s", "end_time_s")


@query(
    "fx11_role_answers",
    """WITH c AS (SELECT user_id AS call_id, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT call_id, n % 6 AS k FROM c)
    SELECT call_id, CASE k WHEN 0 THEN 'spk_0=agent,spk_1=customer' WHEN 1 THEN 'spk_0=agent,spk_1=customer' WHEN 2 THEN 'spk_0=agent,spk_1=customer'
      WHEN 3 THEN 'spk_0=customer,spk_1=agent' END AS roles FROM k""",
)
def fx11(spark, d):
    from callweave.operators.roles import parse_role_answer

    k = F.col("n") % 6
    raw = (
        F.when(k == 0, '{"spk_0":"agent","spk_1":"customer"}')
        .when(k == 1, '```json\n{"spk_0":"agent","spk_1":"uncertain"}\n```')
        .when(k == 2, '{"spk_1":"customer","spk_7":"agent"}')
        .when(k == 3, '{"spk_0":"customer"}')
        .when(k == 4, '{"spk_0":"uncertain","spk_1":"uncertain"}')
        .otherwise("not json")
    )
    answers = (
        standins.table(spark, d, "events")
        .groupBy(F.col("user_id").alias("call_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("call_id", raw.alias("raw"), F.array(F.lit("spk_0"), F.lit("spk_1")).alias("speakers"))
    )
    pairs = F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return parse_role_answer(answers).select("call_id", F.array_join(pairs, ",").alias("roles"))


