"""Speaker embeddings: centroids, confidence, separability, boundaries and decoding.

Vectors of a group are summed element by element with partial sums per task, so a group may hold
any share of the rows; what comes back is one vector per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.numeric import block_of, steady
from callweave.functions.vectors import argmax, cosine_distance, cosine_similarity, dot, norm, scale, subtract, unit
from callweave.operators.monoid import carried_maximum, island_parts
from callweave.operators.scans import BLOCK_ROWS, Run, quantiles, running, shared

CALL = ["call_id"]


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str, name: str = "vec_sum") -> DataFrame:
    """Element-wise sum and row count per group: keys, ``name``, ``n_vectors``.

    A summarizer keeps one vector per group and task and merges those: no row per element is made.
    """
    total = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vector)))
    return (
        df.groupBy(*keys)
        .agg(total.alias("__t"))
        .select(*keys, vector_to_array("__t.sum").alias(name), F.col("__t.count").alias("n_vectors"))
    )


def centroids(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    sums = vector_sums(df, keys, vector)
    return sums.select(*keys, scale(F.col("vec_sum"), 1.0 / F.col("n_vectors")).alias("centroid"), "n_vectors")


# --- anchors and labels ------------------------------------------------------------------------
def anchor_turns(turns: DataFrame) -> DataFrame:
    """The longest turns of each speaker, between 3 and 8 of them; earlier turns win ties."""
    counts = turns.groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    fewest = counts.groupBy("call_id").agg(F.min("n").alias("m"))
    limits = fewest.select("call_id", F.greatest(F.lit(3), F.least(F.lit(8), F.col("m"))).alias("n_anchors"))
    rank = Window.partitionBy("call_id", "speaker").orderBy(F.col("duration_s").desc(), "seg_idx")
    # Never more than 8 per speaker, which Spark can apply before the shuffle.
    top = turns.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= 8)
    return top.join(limits, "call_id").where(F.col("rank") <= F.col("n_anchors"))


def nearest_speaker(turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distance of every turn to both speakers' anchor centroids, margin and label.

    The speaker of the call's first turn is spk_0. Calls with fewer than two speakers get margin 0
    and spk_0.
    """
    cents = centroids(anchors, ["call_id", "speaker"])
    first = turns.groupBy("call_id").agg(F.min_by("speaker", "seg_idx").alias("__first"))
    cents = cents.join(first, "call_id")
    is_first = F.col("speaker") == F.col("__first")
    pair = cents.groupBy("call_id").agg(
        F.max(F.when(is_first, F.col("centroid"))).alias("c0"),
        F.min_by(F.when(~is_first, F.col("centroid")), F.when(~is_first, F.col("speaker"))).alias("c1"),
    )
    joined = turns.join(pair, "call_id")
    known = F.col("c0").isNotNull() & F.col("c1").isNotNull()
    zero = F.lit(0.0)
    out = joined.withColumns(
        {
            "d0": F.when(known, cosine_distance(F.col("embedding"), F.col("c0"))).otherwise(zero),
            "d1": F.when(known, cosine_distance(F.col("embedding"), F.col("c1"))).otherwise(zero),
        }
    )
    out = out.withColumn("margin", F.col("d1") - F.col("d0"))
    return out.withColumn("emb_speaker", F.when(F.col("margin") >= 0, "spk_0").otherwise("spk_1")).drop("c0", "c1")


# --- confidence --------------------------------------------------------------------------------
def silhouette_confidence(turns: DataFrame) -> DataFrame:
    """Cosine silhouette per turn, mapped to 0..1, without forming any pair of turns.

    The mean cosine distance from a unit vector u to a cluster is 1 - u.S/n with S the sum of the
    cluster's unit vectors (for its own cluster, S - u and n - 1). So one vector per (call, speaker)
    is all a turn has to meet. Rules for small calls: under three turns or two speakers gives 0.5;
    a speaker with one turn switches the call to centroid distances; ``overlap`` turns get 0.5.
    """
    valid = turns.where(F.col("speaker") != "overlap").select(
        "call_id", "seg_idx", "speaker", "embedding", unit(F.col("embedding")).alias("u")
    )
    plain = vector_sums(valid, ["call_id", "speaker"], "embedding", "raw_sum")
    units = vector_sums(valid, ["call_id", "speaker"], "u", "unit_sum").drop("n_vectors")
    clusters = plain.join(units, ["call_id", "speaker"])
    # A call has as many entries here as it has speakers.
    per_call = clusters.groupBy("call_id").agg(
        F.collect_list(F.struct("speaker", "n_vectors", "unit_sum", "raw_sum")).alias("clusters"),
        F.min("n_vectors").alias("smallest"),
        F.sum("n_vectors").alias("n_valid"),
    )
    rows = valid.join(per_call, "call_id")
    own = F.get(F.filter("clusters", lambda c: c["speaker"] == F.col("speaker")), F.lit(0))
    others = F.filter("clusters", lambda c: c["speaker"] != F.col("speaker"))
    u, e = F.col("u"), F.col("embedding")
    rows = rows.withColumns({"own": own, "others": others})
    n_own = F.col("own.n_vectors")
    rows = rows.withColumns(
        {
            "a": F.when(n_own > 1, 1.0 - dot(u, subtract(F.col("own.unit_sum"), u)) / (n_own - 1)),
            "b": F.array_min(F.transform("others", lambda c: 1.0 - dot(u, c["unit_sum"]) / c["n_vectors"])),
            "own_d": cosine_distance(e, scale(F.col("own.raw_sum"), 1.0 / n_own)),
            "other_d": F.array_min(
                F.transform("others", lambda c: cosine_distance(e, scale(c["raw_sum"], 1.0 / c["n_vectors"])))
            ),
        }
    )
    top = F.greatest("a", "b")
    sil = F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    both = F.col("own_d") + F.col("other_d")
    by_centroid = F.when(both > 0, F.col("other_d") / both).otherwise(0.5)
    raw = F.when(F.col("smallest") < 2, by_centroid).otherwise((sil + 1.0) / 2.0)
    usable = (F.col("n_valid") >= 3) & (F.size("clusters") >= 2)
    clipped = F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0)))
    scored = rows.select("call_id", "seg_idx", F.when(usable, clipped).alias("__c"))
    out = turns.select("call_id", "seg_idx", "speaker").join(scored, ["call_id", "seg_idx"], "left")
    return out.select(
        "call_id",
        "seg_idx",
        "speaker",
        F.coalesce(steady(F.col("__c"), 4), F.lit(0.5)).alias("confidence"),
        (F.col("__c").isNull() | (steady(F.col("__c"), 9) < 0.5)).alias("uncertain"),
    )


# --- separability ------------------------------------------------------------------------------
def loudest_class(chunks: DataFrame) -> DataFrame:
    """Per chunk the embedding with the largest norm; the lower class wins a tie."""
    ranked = F.struct(norm(F.col("embedding")).alias("n"), (-F.col("class_idx")).alias("neg"), "embedding")
    return chunks.groupBy("call_id", "chunk_idx").agg(F.max(ranked).alias("b")).select(
        "call_id", "chunk_idx", F.col("b.embedding").alias("embedding")
    )


def rolling_separability(
    chunks: DataFrame,
    cents: DataFrame,
    chunk_start: float,
    chunk_step: float,
    chunk_duration: float,
    window_s: float = 5.0,
    step_s: float = 1.0,
) -> DataFrame:
    """Cosine distance between the two speakers' mean embeddings in sliding windows.

    ``chunks`` has (call_id, chunk_idx, embedding), ``cents`` (call_id, class_idx, centroid). A
    chunk lies in window_s / step_s windows, so each row is copied that many times at most.
    """
    per_call = cents.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct("class_idx", "centroid"))).alias("cents")
    ).where(F.size("cents") >= 2)
    ends = chunks.groupBy("call_id").agg(
        (F.lit(chunk_start) + F.max("chunk_idx") * F.lit(chunk_step) + F.lit(chunk_duration)).alias("total_s")
    )
    rows = chunks.join(per_call, "call_id").join(ends, "call_id")
    dists = F.transform("cents", lambda c: cosine_distance(F.col("embedding"), c["centroid"]))
    rows = rows.withColumn("__d", dists).withColumn(
        "group_idx", F.array_position("__d", F.array_min("__d")).cast("int") - 1
    )
    centre = F.lit(chunk_start) + F.col("chunk_idx") * F.lit(chunk_step) + F.lit(chunk_duration / 2.0)
    rel = centre - F.lit(chunk_start)
    first = F.greatest(F.floor((rel - F.lit(window_s)) / F.lit(step_s)) + 1, F.lit(0)).cast("long")
    last = F.least(
        F.floor(rel / F.lit(step_s)),
        F.floor((F.col("total_s") + F.lit(step_s) - F.lit(window_s) - F.lit(chunk_start)) / F.lit(step_s)),
    ).cast("long")
    rows = rows.where(last >= first).withColumn("win", F.explode(F.sequence(first, last)))
    sums = vector_sums(rows, ["call_id", "win", "group_idx"], "embedding")
    wins = sums.groupBy("call_id", "win").agg(
        F.sum("n_vectors").alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("group_idx", "vec_sum"))).alias("g"),
    )
    early = F.col("win") * F.lit(step_s) < window_s
    enough = F.col("n_chunks") >= F.when(early, 1).otherwise(2)
    wins = wins.where(enough & (F.size("g") >= 2)).join(ends, "call_id")
    # The cosine of two sums equals the cosine of the two means.
    distance = cosine_distance(F.get("g", F.lit(0))["vec_sum"], F.get("g", F.lit(1))["vec_sum"])
    at = F.lit(chunk_start) + F.col("win") * F.lit(step_s)
    return wins.select(
        "call_id",
        "win",
        steady(at, 2).alias("start_s"),
        steady(F.least(at + window_s, F.col("total_s")), 2).alias("end_s"),
        steady(distance, 4).alias("separability"),
    )


def low_separability_regions(
    curve: DataFrame, fraction: float = 0.25, pad_s: float = 2.0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Stretches of windows at or below the call's 25th percentile, merged and padded."""
    curve = shared(curve)
    cut = quantiles(curve, CALL, "separability", {"cut": fraction}).drop("n_values")
    low = curve.join(cut, "call_id").where(steady(F.col("separability"), 9) <= steady(F.col("cut"), 9))
    block = block_of(F.col("win"), block_rows)
    # All windows are one stretch.
    low = carried_maximum(low.withColumn("__all", F.lit(0)), CALL, ["win"], block, "__all", "end_s", "__end")
    apart = F.col("__end").isNull() | (F.col("start_s") > F.col("__end") + 1.0)
    parts = {"a": F.min("start_s"), "b": F.max("end_s"), "min_separability": F.min("separability")}
    whole = {"a": F.min("a"), "b": F.max("b"), "min_separability": F.min("min_separability")}
    return (
        island_parts(low, CALL, ["win"], apart, "region", parts, whole)
        .select(
            "call_id",
            (F.col("region") - 1).alias("region"),
            steady(F.greatest(F.lit(0.0), F.col("a") - pad_s), 2).alias("start_s"),
            steady(F.col("b") + pad_s, 2).alias("end_s"),
            "min_separability",
        )
    )


# --- single speaker and boundaries -------------------------------------------------------------
def single_speaker(activations: DataFrame, turn_counts: DataFrame) -> DataFrame:
    """Whether one speaker dominates every chunk of a call.

    ``activations`` has (call_id, chunk_idx, frame_idx, probs) with at least three classes.
    """
    p1, p2 = F.get("probs", F.lit(1)), F.get("probs", F.lit(2))
    per_chunk = activations.groupBy("call_id", "chunk_idx").agg(
        F.avg(F.when(p1 > p2, 1.0).otherwise(0.0)).alias("r0"), F.avg(F.when(p2 > p1, 1.0).otherwise(0.0)).alias("r1")
    )
    dominant = F.when(F.col("r0") > F.col("r1"), 0).otherwise(1)
    per_call = per_chunk.groupBy("call_id").agg(
        F.min(dominant).alias("lo"), F.max(dominant).alias("hi"), F.avg(F.greatest("r0", "r1")).alias("dominance")
    )
    out = turn_counts.select("call_id", "n_turns").join(per_call, "call_id", "left")
    usable = (F.col("n_turns") >= 3) & F.col("dominance").isNotNull()
    single = (F.col("lo") == F.col("hi")) & (steady(F.col("dominance"), 9) > 0.90)
    return out.select(
        "call_id",
        F.when(usable, single).otherwise(False).alias("is_single"),
        steady(F.when(usable, F.col("dominance")).otherwise(0.5), 4).alias("dominance"),
    )


def boundary_features(chunks: DataFrame, activations: DataFrame | None = None) -> DataFrame:
    """How much a chunk differs from the one before it.

    ``chunks`` has (call_id, chunk_idx, class_idx, embedding) with a handful of classes per chunk,
    so a chunk meets classes x classes rows of its predecessor.
    """
    prev = chunks.select(
        "call_id",
        (F.col("chunk_idx") + 1).alias("chunk_idx"),
        F.col("class_idx").alias("prev_class"),
        F.col("embedding").alias("prev_emb"),
    )
    pairs = chunks.join(prev, ["call_id", "chunk_idx"])
    sim = cosine_similarity(F.col("prev_emb"), F.col("embedding"))
    gap = subtract(F.col("prev_emb"), F.col("embedding"))
    pairs = pairs.select(
        "call_id",
        "chunk_idx",
        "class_idx",
        "prev_class",
        F.round(sim, 12).alias("sim"),
        norm(gap).alias("l2"),
        F.when(
            F.col("class_idx") == F.col("prev_class"),
            F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + F.abs(x)) / F.size(gap),
        ).alias("mad"),
    )
    # The first best pair in (previous slot, slot) order gives the distance.
    first_best = F.struct("sim", (-F.col("prev_class")).alias("p"), (-F.col("class_idx")).alias("c"))
    out = pairs.groupBy("call_id", "chunk_idx").agg(
        F.max("sim").alias("best_sim"),
        F.min("sim").alias("min_sim"),
        F.avg("sim").alias("mean_sim"),
        F.max_by("l2", first_best).alias("best_l2"),
        F.avg("mad").alias("mean_abs_diff"),
    )
    if activations is None:
        return out.withColumns({c: F.lit(0.0) for c in ("change_ratio", "mass_delta_1", "mass_delta_2")})
    act = activations.select(
        "call_id",
        "chunk_idx",
        "frame_idx",
        argmax(F.col("probs")).alias("active"),
        F.get("probs", F.lit(1)).alias("m1"),
        F.get("probs", F.lit(2)).alias("m2"),
    )
    before = act.select(
        "call_id",
        (F.col("chunk_idx") + 1).alias("chunk_idx"),
        "frame_idx",
        F.col("active").alias("was"),
        F.col("m1").alias("w1"),
        F.col("m2").alias("w2"),
    )
    deltas = (
        act.join(before, ["call_id", "chunk_idx", "frame_idx"])
        .groupBy("call_id", "chunk_idx")
        .agg(
            F.avg(F.when(F.col("active") != F.col("was"), 1.0).otherwise(0.0)).alias("change_ratio"),
            F.abs(F.avg(F.col("m1") - F.col("w1"))).alias("mass_delta_1"),
            F.abs(F.avg(F.col("m2") - F.col("w2"))).alias("mass_delta_2"),
        )
    )
    return out.join(deltas, ["call_id", "chunk_idx"])


BOUNDARY_FEATURES = [
    "best_sim", "min_sim", "mean_sim", "best_l2", "mean_abs_diff", "change_ratio", "mass_delta_1", "mass_delta_2",
]


def train_boundary_model(features: DataFrame, label: str = "label"):
    """Scaled logistic regression over boundary features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=BOUNDARY_FEATURES, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
            LogisticRegression(featuresCol="__x", labelCol=label, maxIter=50, regParam=0.01),
        ]
    ).fit(features)


def score_boundaries(features: DataFrame, model=None) -> DataFrame:
    """Add ``boundary_score``; 0.5 everywhere when there is no model."""
    if model is None:
        return features.withColumn("boundary_score", F.lit(0.5))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features).withColumn("boundary_score", vector_to_array("probability")[1])
    return scored.drop("__raw", "__x", "rawPrediction", "probability", "prediction")


# --- two-state decoding ------------------------------------------------------------------------
def decode_regions(
    items: DataFrame, keys: Sequence[str] = ("call_id", "region"), switch: float = 0.10, stay: float = 0.08,
    block_rows: int = 512,
) -> DataFrame:
    """Best speaker sequence of a region from the distances to both speakers.

    ``items`` has keys, seg_idx, start_time_s, end_time_s, d0, d1. The two-state recursion is a
    (max, +) product of 2x2 matrices, which is associative: each block of turns is folded to one
    matrix, the matrices are scanned per region, and each block is then folded again from its entry
    state. No fold covers more than ``block_rows`` turns, except that of the block matrices.
    """
    keys = list(keys)
    blk = block_of(F.col("seg_idx"), block_rows)
    rows = running(
        shared(items), keys, ["seg_idx"], blk, {"__prev_end": Run("last", F.col("end_time_s"), inclusive=False)}
    ).withColumn("__blk", blk)
    total = F.col("d0") + F.col("d1")
    lit0 = F.lit(0.0)
    both = F.col("start_time_s") < F.col("__prev_end") - 0.05
    rows = rows.withColumns(
        {
            "e0": F.when(total < 1e-8, lit0).otherwise(-F.col("d0") / F.greatest(total, F.lit(1e-8))),
            "e1": F.when(total < 1e-8, lit0).otherwise(-F.col("d1") / F.greatest(total, F.lit(1e-8))),
            "ps": F.when(F.col("__prev_end").isNull() | both, lit0).otherwise(F.lit(stay)),
            "pw": F.when(F.col("__prev_end").isNull() | both, lit0).otherwise(F.lit(switch)),
        }
    )
    step = F.struct("seg_idx", "e0", "e1", "ps", "pw")
    blocks = rows.groupBy(*keys, "__blk").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    start = F.struct(
        F.lit(0.0).alias("m00"), F.lit(float("-inf")).alias("m01"), F.lit(float("-inf")).alias("m10"), F.lit(0.0).alias("m11")
    )

    def advance(a: Column, b: Column, s: Column) -> tuple[Column, Column]:
        """Scores of both states after one turn, from scores a and b before it."""
        n0 = F.greatest(a - s["ps"], b - s["pw"]) + s["e0"]
        n1 = F.greatest(a - s["pw"], b - s["ps"]) + s["e1"]
        return n0, n1

    def grow(m: Column, s: Column) -> Column:
        a0, a1 = advance(m["m00"], m["m01"], s)
        b0, b1 = advance(m["m10"], m["m11"], s)
        return F.struct(a0.alias("m00"), a1.alias("m01"), b0.alias("m10"), b1.alias("m11"))

    blocks = blocks.withColumn("mat", F.aggregate("steps", start, grow))
    def enter(s: Column, m: Column) -> Column:
        return F.struct(
            F.greatest(s["s0"] + m["m00"], s["s1"] + m["m10"]).alias("s0"),
            F.greatest(s["s0"] + m["m01"], s["s1"] + m["m11"]).alias("s1"),
        )

    def leave(s: Column, m: Column) -> Column:
        return F.struct(
            F.greatest(m["m00"] + s["s0"], m["m01"] + s["s1"]).alias("s0"),
            F.greatest(m["m10"] + s["s0"], m["m11"] + s["s1"]).alias("s1"),
        )

    # One small matrix per block of turns: the list of a region is 1/block_rows of its length.
    chain = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__blk", "mat"))).alias("ms"))
    seed = F.struct(
        F.lit(0.0).alias("s0"), F.lit(0.0).alias("s1"), F.array().cast("array<struct<s0:double,s1:double>>").alias("seen")
    )

    def note(move):
        def fold(acc: Column, item: Column) -> Column:
            now = F.struct(acc["s0"].alias("s0"), acc["s1"].alias("s1"))
            then = move(acc, item["mat"])
            return F.struct(
                then["s0"].alias("s0"), then["s1"].alias("s1"), F.concat(acc["seen"], F.array(now)).alias("seen")
            )

        return fold

    chain = chain.select(
        *keys,
        F.transform("ms", lambda x: x["__blk"]).alias("blks"),
        F.aggregate("ms", seed, note(enter))["seen"].alias("ins"),
        F.reverse(F.aggregate(F.reverse("ms"), seed, note(leave))["seen"]).alias("outs"),
    )
    edges = chain.select(*keys, F.inline(F.arrays_zip("blks", "ins", "outs"))).select(
        *keys, F.col("blks").alias("__blk"), F.col("ins").alias("s_in"), F.col("outs").alias("s_out")
    )
    joined = blocks.drop("mat").join(edges, [*keys, "__blk"])
    # Forward fold keeps the scores before each turn's choice; the backward fold from s_out then
    # picks the state, so the path agrees with the best total over the whole region.
    walk = F.aggregate(
        "steps",
        F.struct(
            F.col("s_in.s0").alias("s0"),
            F.col("s_in.s1").alias("s1"),
            F.array().cast("array<struct<seg_idx:long,f0:double,f1:double,ps:double,pw:double>>").alias("t"),
        ),
        lambda acc, s: _walk_step(acc, s, advance),
    )
    joined = joined.withColumn("trail", walk["t"])
    pick = F.aggregate(
        F.reverse("trail"),
        F.struct(
            F.lit(None).cast("int").alias("state"),
            F.col("s_out.s0").alias("o0"),
            F.col("s_out.s1").alias("o1"),
            F.lit(0.0).alias("ps"),
            F.lit(0.0).alias("pw"),
            F.array().cast("array<struct<seg_idx:long,state:int>>").alias("path"),
        ),
        _pick_step,
    )
    # Entry ties are decided inside each block from the same totals, so neighbouring blocks agree
    # unless two whole paths tie exactly.
    return joined.select(*keys, F.inline(pick["path"])).select(
        *keys, "seg_idx", F.when(F.col("state") == 0, "spk_0").otherwise("spk_1").alias("speaker")
    )


def _walk_step(acc: Column, s: Column, advance) -> Column:
    n0, n1 = advance(acc["s0"], acc["s1"], s)
    entry = F.struct(s["seg_idx"].cast("long").alias("seg_idx"), n0.alias("f0"), n1.alias("f1"), s["ps"].alias("ps"), s["pw"].alias("pw"))
    return F.struct(n0.alias("s0"), n1.alias("s1"), F.concat(acc["t"], F.array(entry)).alias("t"))


def _pick_step(acc: Column, t: Column) -> Column:
    """Choose the state of one turn, given the state chosen for the turn after it."""
    a = t["f0"] - F.when(acc["state"] == 0, acc["ps"]).when(acc["state"] == 1, acc["pw"]).otherwise(-acc["o0"])
    b = t["f1"] - F.when(acc["state"] == 1, acc["ps"]).when(acc["state"] == 0, acc["pw"]).otherwise(-acc["o1"])
    state = F.when(a >= b, 0).otherwise(1)
    return F.struct(
        state.alias("state"),
        acc["o0"].alias("o0"),
        acc["o1"].alias("o1"),
        t["ps"].alias("ps"),
        t["pw"].alias("pw"),
        F.concat(F.array(F.struct(t["seg_idx"].alias("seg_idx"), state.alias("state"))), acc["path"]).alias("path"),
    )


def mark_low_regions(turns: DataFrame, regions: DataFrame) -> DataFrame:
    """Add ``in_low``: whether the turn's centre lies in a low-separability region."""
    centre = (F.col("start_time_s") + F.col("end_time_s")) / 2.0
    points = turns.select("call_id", "seg_idx", centre.alias("at"))
    from callweave.operators.align import points_in_regions

    inside = points_in_regions(points, regions, "at").select("call_id", "seg_idx", F.lit(True).alias("__in"))
    return turns.join(inside, ["call_id", "seg_idx"], "left").withColumn("in_low", F.coalesce("__in", F.lit(False))).drop("__in")
