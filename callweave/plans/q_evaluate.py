"""Queries over evaluation and annotation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import align, evaluate
from callweave.plans import standins
from callweave.plans.oracle import DIAR, SEG, rnd
from callweave.plans.registry import query

PRED = f"""{SEG}, {DIAR}, pd AS (SELECT call_id, seg_idx, CASE speaker WHEN 'spk_0' THEN 'agent' WHEN 'spk_1' THEN 'customer' ELSE 'overlap' END AS speaker,
  start_time_s, end_time_s, (length(text) % 100) / 100.0::DOUBLE AS confidence FROM diar),
hz AS (SELECT call_id, ceil(max(end_time_s))::BIGINT AS n FROM seg GROUP BY call_id),
ts AS (SELECT call_id, second, arg_max(speaker, seg_idx) AS truth FROM (SELECT *, unnest(range(floor(start_time_s)::BIGINT, ceil(end_time_s)::BIGINT)) AS second FROM seg) GROUP BY call_id, second),
pu AS (SELECT p.*, unnest(range(floor(start_time_s)::BIGINT, least(ceil(end_time_s)::BIGINT, n))) AS second FROM pd p JOIN hz ON p.call_id = hz.call_id),
ps AS (SELECT call_id, second, arg_max(speaker, seg_idx) AS predicted FROM pu GROUP BY call_id, second),
tl AS (SELECT coalesce(t.call_id, p.call_id) AS call_id, coalesce(t.second, p.second) AS second, coalesce(truth, 'silence') AS truth, coalesce(predicted, 'silence') AS predicted
  FROM ts t FULL JOIN ps p ON t.call_id = p.call_id AND t.second = p.second),
ti AS (SELECT *, CASE predicted WHEN 'agent' THEN 'customer' WHEN 'customer' THEN 'agent' ELSE predicted END AS inv FROM tl WHERE truth <> 'silence')"""


def _sides(spark, d):
    truth = standins.segments(spark, d)
    who = F.when(F.col("speaker") == "spk_0", "agent").when(F.col("speaker") == "spk_1", "customer").otherwise("overlap")
    pred = standins.diarized(spark, d).withColumn("speaker", who).withColumn("confidence", (F.length("text") % 100) / 100.0)
    horizon = truth.groupBy("call_id").agg(F.ceil(F.max("end_time_s")).cast("long").alias("n_seconds"))
    return truth, pred, horizon


@query("jn12_timeline", f"WITH {PRED} SELECT * FROM tl")
def jn12(spark, d):
    return evaluate.timeline(*_sides(spark, d))


@query(
    "ag23_accuracy",
    f"""WITH {PRED}, c AS (SELECT call_id, count(*) AS active_s, count(*) FILTER (truth = predicted OR (truth = 'overlap' AND predicted IN ('agent', 'customer'))) AS direct,
      count(*) FILTER (truth = inv OR (truth = 'overlap' AND inv IN ('agent', 'customer'))) AS inverted FROM ti GROUP BY call_id)
    SELECT call_id, active_s, {rnd("direct * 100.0 / active_s", 2)} AS direct_pct, {rnd("inverted * 100.0 / active_s", 2)} AS inverted_pct,
      {rnd("greatest(direct, inverted) * 100.0 / active_s", 2)} AS best_pct, inverted > direct AS is_inverted FROM c""",
)
def ag23(spark, d):
    return evaluate.accuracy(evaluate.stretches(*_sides(spark, d)))


@query(
    "ag24_confidence_gap",
    f"""WITH {PRED}, o AS (SELECT p.call_id, p.seg_idx, bool_and(truth = speaker OR (truth = 'overlap' AND speaker IN ('agent', 'customer'))) AS ok, max(confidence) AS conf
      FROM pu p JOIN ts ON p.call_id = ts.call_id AND p.second = ts.second GROUP BY p.call_id, p.seg_idx)
    SELECT call_id, count(*) FILTER (ok) AS n_right, count(*) FILTER (NOT ok) AS n_wrong, {rnd("avg(conf) FILTER (ok)", 4)} AS mean_right,
      {rnd("avg(conf) FILTER (NOT ok)", 4)} AS mean_wrong, {rnd("(avg(conf) FILTER (ok)) - (avg(conf) FILTER (NOT ok))", 4)} AS gap FROM o GROUP BY call_id""",
)
def ag24(spark, d):
    return evaluate.confidence_gap(*_sides(spark, d))


RATERS = """ra AS (SELECT doc_id AS utterance_id, 'A' AS annotator_id, quality::BIGINT AS label FROM labels UNION ALL SELECT doc_id, 'B', 1 - toxic FROM labels
  UNION ALL SELECT l.doc_id, 'C', CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _ratings(spark, d):
    lab = standins.table(spark, d, "labels")
    size = standins.table(spark, d, "documents").select("doc_id", "n_chars")
    rows = lab.join(size, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("utterance_id"),
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.lit("A").alias("annotator_id"), F.col("quality").cast("long").alias("label")),
                    F.struct(F.lit("B").alias("annotator_id"), (1 - F.col("toxic")).cast("long").alias("label")),
                    F.when(
                        F.col("n_chars").isNotNull(),
                        F.struct(F.lit("C").alias("annotator_id"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).cast("long").alias("label")),
                    ),
                )
            )
        ),
    )


@query(
    "ag26_kappa",
    f"""WITH {RATERS}, p AS (SELECT a.label AS la, b.label AS lb FROM ra a JOIN ra b ON a.utterance_id = b.utterance_id AND a.annotator_id = 'A' AND b.annotator_id = 'B'),
    n AS (SELECT count(*) AS n, avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS po FROM p),
    e AS (SELECT sum(x.n * y.n) / max(n.n * n.n) AS pe FROM (SELECT la AS l, count(*) AS n FROM p GROUP BY la) x JOIN (SELECT lb AS l, count(*) AS n FROM p GROUP BY lb) y ON x.l = y.l, n)
    SELECT n AS n_items, {rnd("po", 4)} AS observed, {rnd("pe", 4)} AS expected, {rnd("(po - pe) / (1 - pe)", 4)} AS kappa FROM n, e""",
)
def ag26(spark, d):
    return evaluate.cohen_kappa(_ratings(spark, d), "A", "B")


@query(
    "ag26_majority_vote",
    f"""WITH {RATERS}, v AS (SELECT utterance_id, label, count(*) AS votes FROM ra GROUP BY utterance_id, label)
    SELECT utterance_id, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY utterance_id ORDER BY votes DESC, label) = 1""",
)
def ag26v(spark, d):
    return evaluate.majority_vote(_ratings(spark, d))


@query(
    "ag26_text_vote",
    """SELECT doc_id // 5 AS utterance_id, lang AS label, count(*) AS votes FROM documents GROUP BY doc_id // 5, lang
    QUALIFY row_number() OVER (PARTITION BY utterance_id ORDER BY votes DESC, label) = 1""",
)
def ag26t(spark, d):
    """Text labels: five documents in a row vote on a language."""
    docs = standins.table(spark, d, "documents")
    ratings = docs.select(F.floor(F.col("doc_id") / 5).alias("utterance_id"), (F.col("doc_id") % 5).alias("annotator_id"), F.col("lang").alias("label"))
    return evaluate.majority_vote(ratings)


@query(
    "ag27_dialogue_split",
    """WITH b AS (SELECT conv_id, turn, ('0x' || left(md5(conv_id::VARCHAR), 8))::BIGINT % 100 AS b FROM conversations)
    SELECT conv_id AS call_id, turn AS seg_idx, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split FROM b""",
)
def ag27(spark, d):
    return standins.table(spark, d, "conversations").select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_idx"), evaluate.dialogue_split(F.col("conv_id")).alias("split")
    )


@query(
    "ag28_dataset_size",
    f"""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), a AS (SELECT count(*) AS n_dialogues, avg(n) AS m FROM s)
    SELECT n_dialogues, {rnd("m", 4)} AS mean_turns, CASE WHEN n_dialogues >= 2000 THEN 'robust' WHEN n_dialogues >= 500 THEN 'minimum' ELSE 'too small' END AS size_class,
      m BETWEEN 10 AND 30 AS turns_in_range FROM a""",
)
def ag28(spark, d):
    return evaluate.dataset_size(standins.table(spark, d, "conversations").select(F.col("conv_id").alias("call_id")))


@query(
    "jn12_seconds_timeline",
    f"""WITH {DIAR} SELECT call_id, second, arg_max(speaker, seg_idx) AS speaker FROM (SELECT *, unnest(range(floor(start_time_s)::BIGINT, ceil(end_time_s)::BIGINT)) AS second FROM diar) GROUP BY call_id, second""",
)
def seconds(spark, d):
    return align.seconds_timeline(standins.diarized(spark, d))
