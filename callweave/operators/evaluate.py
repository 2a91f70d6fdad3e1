"""Checking predictions and annotations: timeline accuracy, confidence gap, agreement, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.numeric import ratio, steady
from callweave.operators.align import seconds_timeline, swept_timeline


def stretches(truth: DataFrame, predicted: DataFrame, horizon: DataFrame | None = None) -> DataFrame:
    """True and predicted speaker per call and stretch of seconds [start_s, stop_s); a silent side is ``silence``."""
    found = swept_timeline({"truth": truth, "predicted": predicted}, horizon)
    return found.na.fill("silence", ["truth", "predicted"])


def timeline(truth: DataFrame, predicted: DataFrame, horizon: DataFrame | None = None) -> DataFrame:
    """True and predicted speaker per call and second; a silent side is ``silence``."""
    second = F.explode(F.sequence(F.col("start_s"), F.col("stop_s") - 1)).alias("second")
    return stretches(truth, predicted, horizon).select("call_id", second, "truth", "predicted")


def _swapped(speaker: Column) -> Column:
    return F.when(speaker == "agent", "customer").when(speaker == "customer", "agent").otherwise(speaker)


def _same(truth: Column, predicted: Column) -> Column:
    return (truth == predicted) | ((truth == "overlap") & predicted.isin("agent", "customer", "overlap"))


def accuracy(found: DataFrame) -> DataFrame:
    """Match rate over active seconds, as labelled and with both speakers swapped, from ``stretches``."""
    truth, pred = F.col("truth"), F.col("predicted")
    seconds = F.col("stop_s") - F.col("start_s")
    during = lambda fits: F.coalesce(F.sum(F.when(fits, seconds)), F.lit(0).cast("long"))
    counts = found.where(truth != "silence").groupBy("call_id").agg(
        F.sum(seconds).alias("active_s"),
        during(_same(truth, pred)).alias("direct"),
        during(_same(truth, _swapped(pred))).alias("inverted"),
    )
    n = F.col("active_s")
    direct, inverted = ratio(F.col("direct") * 100.0, n), ratio(F.col("inverted") * 100.0, n)
    return counts.select(
        "call_id",
        "active_s",
        steady(direct, 2).alias("direct_pct"),
        steady(inverted, 2).alias("inverted_pct"),
        steady(F.greatest(direct, inverted), 2).alias("best_pct"),
        (F.col("inverted") > F.col("direct")).alias("is_inverted"),
    )


def confidence_gap(truth: DataFrame, predicted: DataFrame, horizon: DataFrame | None = None) -> DataFrame:
    """Mean confidence of turns that are right in every active second, of the others, and the gap."""
    t = seconds_timeline(truth, horizon, "truth")
    turns = predicted if horizon is None else predicted.join(horizon, "call_id")
    last = F.ceil("end_time_s").cast("long") - 1
    if horizon is not None:
        last = F.least(last, F.col("n_seconds") - 1)
    first = F.floor("start_time_s").cast("long")
    secs = turns.where(last >= first).select(
        "call_id", "seg_idx", "speaker", "confidence", F.explode(F.sequence(first, last)).alias("second")
    )
    ok = (F.col("truth") == F.col("speaker")) | (
        (F.col("truth") == "overlap") & F.col("speaker").isin("agent", "customer")
    )
    per_turn = (
        secs.join(t, ["call_id", "second"])
        .groupBy("call_id", "seg_idx")
        .agg(F.bool_and(ok).alias("right"), F.max("confidence").alias("confidence"))
    )
    out = per_turn.groupBy("call_id").agg(
        F.count_if(F.col("right")).alias("n_right"),
        F.count_if(~F.col("right")).alias("n_wrong"),
        F.avg(F.when(F.col("right"), F.col("confidence"))).alias("a"),
        F.avg(F.when(~F.col("right"), F.col("confidence"))).alias("b"),
    )
    return out.select(
        "call_id",
        "n_right",
        "n_wrong",
        steady(F.col("a"), 4).alias("mean_right"),
        steady(F.col("b"), 4).alias("mean_wrong"),
        steady(F.col("a") - F.col("b"), 4).alias("gap"),
    )


def cohen_kappa(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement of two annotators beyond chance.

    ``ratings`` has (utterance_id, annotator_id, label). The labels are few, so everything after the
    first aggregation is a small table.
    """
    a = ratings.where(F.col("annotator_id") == first).select("utterance_id", F.col("label").alias("la"))
    b = ratings.where(F.col("annotator_id") == second).select("utterance_id", F.col("label").alias("lb"))
    cells = a.join(b, "utterance_id").groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"))
    marks = cells.select(
        F.inline(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("la").alias("label"), F.col("n").alias("n"), F.lit(0).cast("long").alias("hit")),
                F.struct(F.lit("b").alias("side"), F.col("lb").alias("label"), F.col("n").alias("n"), F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0).alias("hit")),
            )
        )
    )
    per_label = marks.groupBy("label").agg(
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("nb"),
        F.sum("hit").alias("hit"),
    )
    sums = per_label.agg(
        F.sum("na").alias("n_items"), F.sum("hit").alias("hit"), F.sum(F.col("na") * F.col("nb")).alias("cross")
    )
    n = F.col("n_items")
    po, pe = F.col("hit") / n, F.col("cross") / (n * n)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)
    return sums.select("n_items", steady(po, 4).alias("observed"), steady(pe, 4).alias("expected"), steady(kappa, 4).alias("kappa"))


def majority_vote(ratings: DataFrame) -> DataFrame:
    """Most frequent label per utterance; the smaller label wins a tie. Adds the vote count."""
    votes = ratings.groupBy("utterance_id", "label").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct((-F.col("n")).alias("fewer"), "label")
    top = votes.groupBy("utterance_id").agg(F.min_by(F.struct("label", "n"), first).alias("t"))
    return top.select("utterance_id", "t.label", F.col("t.n").alias("votes"))


def dialogue_split(dialogue_id: Column) -> Column:
    """train / validation / test (70 / 15 / 15) from a hash of the dialogue, so its turns stay together."""
    bucket = F.pmod(F.conv(F.left(F.md5(dialogue_id.cast("string")), F.lit(8)), 16, 10).cast("long"), F.lit(100))
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def dataset_size(turns: DataFrame) -> DataFrame:
    """Whether a set of dialogues is large enough to train on."""
    sizes = turns.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.count(F.lit(1)).alias("n_dialogues"), F.avg("n").alias("m"))
    n = F.col("n_dialogues")
    return out.select(
        "n_dialogues",
        steady(F.col("m"), 4).alias("mean_turns"),
        F.when(n >= 2000, "robust").when(n >= 500, "minimum").otherwise("too small").alias("size_class"),
        F.col("m").between(10, 30).alias("turns_in_range"),
    )


def scan_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of a scan against labelled calls (call_id, toxic)."""
    hit = found.select("call_id").distinct().withColumn("hit", F.lit(True))
    both = truth.join(hit, "call_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    bad = F.col("toxic") == 1
    c = both.agg(
        F.count_if(F.col("hit") & bad).alias("tp"),
        F.count_if(F.col("hit") & ~bad).alias("fp"),
        F.count_if(~F.col("hit") & bad).alias("fn"),
    )
    return c.select(
        "tp",
        "fp",
        "fn",
        steady(ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 4).alias("precision"),
        steady(ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), 4).alias("recall"),
    )
