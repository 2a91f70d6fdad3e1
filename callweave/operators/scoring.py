"""Call scores: talk time, five QA components, weighted score and grade."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.lexicon import QA_WEIGHTS
from callweave.functions.numeric import ratio, steady
from callweave.functions.rules import is_agent, is_customer, qa_grade, sentiment_value

COMPONENTS = list(QA_WEIGHTS)


def talk_ratio(turns: DataFrame) -> DataFrame:
    """Speaking time and turn counts of spk_0 (agent), spk_1 (customer) and everybody else."""
    who = F.col("speaker")
    first, second = who == "spk_0", who == "spk_1"
    other = ~(first | second)
    d = F.col("duration_s")
    sums = turns.groupBy("call_id").agg(
        F.sum(F.when(first, d).otherwise(0.0)).alias("a"),
        F.sum(F.when(second, d).otherwise(0.0)).alias("c"),
        F.sum(F.when(other, d).otherwise(0.0)).alias("o"),
        F.count_if(first).alias("agent_segments"),
        F.count_if(second).alias("customer_segments"),
        F.count_if(other).alias("overlap_segments"),
    )
    speech = F.col("a") + F.col("c")
    return sums.select(
        "call_id",
        steady(F.col("a"), 2).alias("agent_duration_s"),
        steady(F.col("c"), 2).alias("customer_duration_s"),
        steady(F.col("o"), 2).alias("overlap_duration_s"),
        steady(speech, 2).alias("total_speech_s"),
        steady(ratio(F.col("a"), speech), 4).alias("agent_ratio"),
        steady(ratio(F.col("c"), speech), 4).alias("customer_ratio"),
        "agent_segments",
        "customer_segments",
        "overlap_segments",
    )


def compliance_score(total: Column, by_agent: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(
        F.greatest(F.lit(0.0), 100.0 - F.least(total * 10 + by_agent * 5, F.lit(100)))
    )


def component_scores(turns: DataFrame) -> DataFrame:
    """All five components of every call in one aggregation.

    ``turns`` has speaker, start_time_s, end_time_s, sentiment, confidence and violation_count.
    """
    agent, customer = is_agent(F.col("speaker")), is_customer(F.col("speaker"))
    base = sentiment_value(F.col("sentiment"))
    conf = F.coalesce("confidence", F.lit(1.0))
    seconds = F.col("end_time_s") - F.col("start_time_s")
    v = F.coalesce("violation_count", F.lit(0).cast("long"))
    sums = turns.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.avg(F.when(customer, base * conf + 0.5 * (1 - conf))).alias("cust"),
        F.sum(v).alias("total_violations"),
        F.sum(F.when(agent, v).otherwise(0)).alias("agent_violations"),
        F.count_if(agent).alias("n_agent"),
        F.var_pop(F.when(agent, base)).alias("spread"),
        F.avg(F.when(F.lower("sentiment") == "positive", 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(agent, seconds).otherwise(0.0)).alias("agent_s"),
        F.sum(seconds).alias("all_s"),
    )
    share = F.when(F.col("all_s") != 0, F.col("agent_s") / F.col("all_s") * 100)
    off = F.least(F.abs(share - 50), F.lit(50.0))
    total = F.col("total_violations")
    return sums.select(
        "call_id",
        "n_turns",
        "total_violations",
        "agent_violations",
        steady(F.coalesce(F.col("cust") * 100, F.lit(50.0)), 1).alias("customer_sentiment"),
        steady(compliance_score(total, F.col("agent_violations")), 1).alias("compliance"),
        F.when(F.col("n_agent") == 0, 75.0)
        .when(F.col("n_agent") == 1, 80.0)
        .otherwise(steady(F.greatest(F.lit(0.0), 1 - F.col("spread") * 4) * 100, 1))
        .alias("agent_stability"),
        steady(
            F.least(70.0 + F.when(total == 0, 15.0).otherwise(0.0) + F.col("pos") * 15, F.lit(100.0)), 1
        ).alias("intent_resolution"),
        F.when(share.isNull(), 50.0)
        .when((steady(share, 9) >= 35) & (steady(share, 9) <= 65), 100.0)
        .otherwise(steady(F.greatest(F.lit(0.0), 100 - off * 2), 1))
        .alias("talk_ratio"),
    )


def weight_columns(overrides: Mapping[str, float] | None = None, table: Column | None = None) -> dict[str, Column]:
    """Weight per component. An override replaces the defaults as a whole; what it omits weighs 0.

    ``table`` is a map<string,double> column for per-row overrides; null means the defaults.
    """
    if table is not None:
        return {
            c: F.when(table.isNull(), F.lit(w)).otherwise(F.coalesce(F.try_element_at(table, F.lit(c)), F.lit(0.0)))
            for c, w in QA_WEIGHTS.items()
        }
    if overrides is None:
        return {c: F.lit(w) for c, w in QA_WEIGHTS.items()}
    inner = overrides.get("weights", overrides)
    return {c: F.lit(float(inner.get(c, 0.0))) for c in QA_WEIGHTS}


def grade_calls(components: DataFrame, weights: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``qa_score`` and ``grade``."""
    weights = weights or weight_columns()
    parts = [weights[c] * F.col(c) for c in COMPONENTS]
    score = steady(F.least(sum(parts[1:], parts[0]), F.lit(100.0)), 1)
    return components.withColumn("qa_score", score).withColumn("grade", qa_grade(F.col("qa_score")))


def blank_scores_for_skipped(scores: DataFrame, guard: DataFrame) -> DataFrame:
    """Calls without a transcript keep their row, with null scores and the reason."""
    nulled = [c for c in scores.columns if c != "call_id"]
    joined = guard.join(scores, "call_id", "left")
    ok = F.col("audit_skipped").isNull()
    return joined.select("call_id", "audit_skipped", *[F.when(ok, F.col(c)).alias(c) for c in nulled])


def history(scores: DataFrame) -> DataFrame:
    """Roll-up over grade and compliance across calls."""
    return scores.rollup("grade", "compliant").agg(
        F.grouping_id().cast("long").alias("level"),
        F.count(F.lit(1)).alias("n_calls"),
        steady(F.avg("qa_score"), 4).alias("avg_score"),
        F.sum("total_violations").alias("violations"),
    )
