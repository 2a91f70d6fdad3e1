"""Queries over speaker embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions.numeric import steady
from callweave.functions.vectors import cosine_distance
from callweave.operators import speakers, turns
from callweave.plans import standins
from callweave.plans.oracle import EMB, rnd
from callweave.plans.registry import query


def cosd(a: str, b: str) -> str:
    return f"(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def mean_vectors(name: str, source: str, keys: str) -> str:
    """CTE with the mean vector per group."""
    return f"""{name}_e AS (SELECT {keys}, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM {source}),
{name}_m AS (SELECT {keys}, i, avg(x) AS m FROM {name}_e GROUP BY ALL),
{name} AS (SELECT {keys}, list(m ORDER BY i) AS c FROM {name}_m GROUP BY {keys})"""


@query(
    "fx8_cosine_distance",
    f"""WITH {EMB} SELECT a.call_id, a.seg_idx, {rnd(cosd("a.embedding", "b.embedding"), 6)} AS drift FROM emb a JOIN emb b ON a.call_id = b.call_id AND b.seg_idx = a.seg_idx + 1""",
)
def fx8(spark, d):
    a = standins.embeddings(spark, d).select("call_id", "seg_idx", "embedding")
    b = a.select("call_id", (F.col("seg_idx") - 1).alias("seg_idx"), F.col("embedding").alias("next"))
    return a.join(b, ["call_id", "seg_idx"]).select(
        "call_id", "seg_idx", steady(cosine_distance(F.col("embedding"), F.col("next")), 6).alias("drift")
    )


ANCHORS = f"""{EMB}, an0 AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY duration_s DESC, seg_idx) AS rank FROM emb),
an1 AS (SELECT call_id, greatest(3, least(8, min(n))) AS k FROM (SELECT call_id, speaker, count(*) AS n FROM emb GROUP BY call_id, speaker) GROUP BY call_id),
an AS (SELECT an0.* FROM an0 JOIN an1 ON an0.call_id = an1.call_id WHERE rank <= k)"""


@query("tk2_anchor_turns", f"WITH {ANCHORS} SELECT call_id, speaker, seg_idx, rank FROM an")
def tk2(spark, d):
    return speakers.anchor_turns(standins.embeddings(spark, d)).select(
        "call_id", "speaker", "seg_idx", F.col("rank").cast("long").alias("rank")
    )


NEAREST = f"""{ANCHORS}, {mean_vectors("ce", "an", "call_id, speaker")},
fs AS (SELECT call_id, first(speaker ORDER BY seg_idx) AS f FROM emb GROUP BY call_id),
nd AS (SELECT e.*, {cosd("e.embedding", "c0.c")} AS d0, {cosd("e.embedding", "c1.c")} AS d1 FROM emb e JOIN fs ON e.call_id = fs.call_id
  JOIN ce c0 ON c0.call_id = e.call_id AND c0.speaker = fs.f JOIN ce c1 ON c1.call_id = e.call_id AND c1.speaker <> fs.f),
ns AS (SELECT *, CASE WHEN d1 - d0 >= 0 THEN 'spk_0' ELSE 'spk_1' END AS emb_speaker FROM nd)"""


def _nearest(spark, d):
    emb = standins.embeddings(spark, d)
    return speakers.nearest_speaker(emb, speakers.anchor_turns(emb))


@query(
    "jn7_nearest_speaker",
    f"WITH {NEAREST} SELECT call_id, seg_idx, {rnd('d0', 6)} AS d0, {rnd('d1', 6)} AS d1, {rnd('d1 - d0', 6)} AS margin, emb_speaker FROM ns",
)
def jn7(spark, d):
    out = _nearest(spark, d)
    return out.select("call_id", "seg_idx", *[steady(F.col(c), 6).alias(c) for c in ("d0", "d1", "margin")], "emb_speaker")


# The silhouette from all pairs, against the sum form used by the operator.
@query(
    "ag19_silhouette_confidence",
    f"""WITH {EMB}, pr AS (SELECT a.call_id, a.seg_idx, a.speaker, b.speaker AS other, {cosd("a.embedding", "b.embedding")} AS dist
      FROM emb a JOIN emb b ON a.call_id = b.call_id AND a.seg_idx <> b.seg_idx),
    m AS (SELECT call_id, seg_idx, speaker, avg(dist) FILTER (other = speaker) AS a, avg(dist) FILTER (other <> speaker) AS b FROM pr GROUP BY call_id, seg_idx, speaker),
    s AS (SELECT *, greatest(0, least(((b - a) / greatest(a, b) + 1) / 2, 1)) AS c FROM m)
    SELECT call_id, seg_idx, speaker, {rnd("c", 4)} AS confidence, c < 0.5 AS uncertain FROM s""",
)
def ag19(spark, d):
    return speakers.silhouette_confidence(standins.embeddings(spark, d))


CURVE = f"""{EMB}, {mean_vectors("gc", "emb", "call_id, speaker")},
as_ AS (SELECT e.call_id, e.seg_idx, e.embedding, c.speaker AS grp FROM emb e JOIN gc c ON e.call_id = c.call_id
  QUALIFY row_number() OVER (PARTITION BY e.call_id, e.seg_idx ORDER BY {cosd("e.embedding", "c.c")}, c.speaker) = 1),
en AS (SELECT call_id, max(seg_idx) + 5.0::DOUBLE AS total_s FROM emb GROUP BY call_id),
wi AS (SELECT call_id, total_s, unnest(range(0, floor(total_s + 1 - 5)::BIGINT + 1)) AS win FROM en),
wc AS (SELECT w.call_id, w.win, w.total_s, a.grp, a.embedding FROM wi w JOIN as_ a ON w.call_id = a.call_id AND a.seg_idx + 2.5 >= w.win AND a.seg_idx + 2.5 < w.win + 5),
wn AS (SELECT call_id, win, total_s, count(*) AS n, count(DISTINCT grp) AS g FROM wc GROUP BY call_id, win, total_s),
{mean_vectors("wm", "wc", "call_id, win, grp")},
cv AS (SELECT n.call_id, n.win, round(n.win::DOUBLE, 2) AS start_s, round(least(n.win + 5, total_s), 2) AS end_s, {rnd(cosd("a.c", "b.c"), 4)} AS separability
  FROM wn n JOIN wm a ON a.call_id = n.call_id AND a.win = n.win AND a.grp = 'spk_0' JOIN wm b ON b.call_id = n.call_id AND b.win = n.win AND b.grp = 'spk_1'
  WHERE n.n >= CASE WHEN n.win < 5 THEN 1 ELSE 2 END AND n.g >= 2)"""


def _curve(spark, d):
    emb = standins.embeddings(spark, d)
    chunks = emb.select("call_id", F.col("seg_idx").alias("chunk_idx"), "embedding")
    cents = speakers.centroids(emb, ["call_id", "speaker"]).select("call_id", F.col("speaker").alias("class_idx"), "centroid")
    return speakers.rolling_separability(chunks, cents, 0.0, 1.0, 5.0)


@query("ag20_rolling_separability", f"WITH {CURVE} SELECT call_id, win, start_s, end_s, separability FROM cv")
def ag20(spark, d):
    return _curve(spark, d)


LOW = f"""{CURVE}, ct AS (SELECT call_id, quantile_cont(separability, 0.25) AS cut FROM cv GROUP BY call_id),
lo AS (SELECT c.* FROM cv c JOIN ct ON c.call_id = ct.call_id WHERE round(separability, 9) <= round(cut, 9)),
lm AS (SELECT *, max(end_s) OVER (PARTITION BY call_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM lo),
li AS (SELECT *, sum(CASE WHEN e IS NULL OR start_s > e + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY win) - 1 AS region FROM lm),
lr AS (SELECT call_id, region::BIGINT AS region, round(greatest(0, min(start_s) - 2), 2) AS start_s, round(max(end_s) + 2, 2) AS end_s, min(separability) AS min_separability FROM li GROUP BY call_id, region)"""


@query("wn15_low_separability", f"WITH {LOW} SELECT * FROM lr")
def wn15(spark, d):
    return speakers.low_separability_regions(_curve(spark, d))


@query(
    "pf14_speaker_override",
    f"""WITH {LOW}, {NEAREST[len(EMB) + 2:]},
    o AS (SELECT n.call_id, n.seg_idx, n.speaker, n.emb_speaker, n.seg_idx % 10 = 3 AS is_split, EXISTS (SELECT 1 FROM lr r WHERE r.call_id = n.call_id
      AND r.start_s <= (n.start_time_s + n.end_time_s) / 2 AND (n.start_time_s + n.end_time_s) / 2 <= r.end_s) AS in_low FROM ns n)
    SELECT call_id, seg_idx, in_low, CASE WHEN is_split OR (in_low AND speaker <> emb_speaker) THEN emb_speaker ELSE speaker END AS final_speaker FROM o""",
)
def pf14(spark, d):
    rows = _nearest(spark, d).withColumn("is_split", F.col("seg_idx") % 10 == 3)
    marked = speakers.mark_low_regions(rows, speakers.low_separability_regions(_curve(spark, d)))
    return turns.speaker_override(marked).select("call_id", "seg_idx", "in_low", "final_speaker")


@query(
    "ag21_single_speaker",
    f"""WITH {EMB}, f AS (SELECT call_id, seg_idx, unnest([least(3 * x, 61) FOR x IN range(0, 22)]) AS b, embedding AS e FROM emb),
    c AS (SELECT call_id, seg_idx, avg(CASE WHEN e[b + 2] > e[b + 3] THEN 1.0 ELSE 0.0 END) AS r0, avg(CASE WHEN e[b + 3] > e[b + 2] THEN 1.0 ELSE 0.0 END) AS r1 FROM f GROUP BY call_id, seg_idx),
    s AS (SELECT call_id, min(CASE WHEN r0 > r1 THEN 0 ELSE 1 END) = max(CASE WHEN r0 > r1 THEN 0 ELSE 1 END) AS same, avg(greatest(r0, r1)) AS dom, count(*) AS n FROM c GROUP BY call_id)
    SELECT call_id, n >= 3 AND same AND dom > 0.9 AS is_single, {rnd("CASE WHEN n >= 3 THEN dom ELSE 0.5 END", 4)} AS dominance FROM s""",
)
def ag21(spark, d):
    counts = standins.embeddings(spark, d).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return speakers.single_speaker(standins.activations(spark, d), counts)


BOUNDARY = f"""{EMB}, sl AS (SELECT call_id, seg_idx AS chunk_idx, unnest(range(0, 3)) AS k, embedding AS e FROM emb),
sv AS (SELECT call_id, chunk_idx, k, list_slice(e, k * 21 + 1, k * 21 + 22) AS v FROM sl),
sp AS (SELECT c.call_id, c.chunk_idx, p.k AS i, c.k AS j, round(list_dot_product(p.v, c.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(c.v, c.v))), 12) AS sim,
  list_distance(p.v, c.v) AS l2, CASE WHEN p.k = c.k THEN list_avg(list_transform(list_zip(p.v, c.v), lambda z: abs(z[1] - z[2]))) END AS mad
  FROM sv c JOIN sv p ON p.call_id = c.call_id AND p.chunk_idx = c.chunk_idx - 1),
sf AS (SELECT call_id, chunk_idx, max(sim) AS best_sim, min(sim) AS min_sim, avg(sim) AS mean_sim, first(l2 ORDER BY sim DESC, i, j) AS best_l2, avg(mad) AS mean_abs_diff FROM sp GROUP BY call_id, chunk_idx),
ac AS (SELECT call_id, seg_idx AS chunk_idx, unnest([least(3 * x, 61) FOR x IN range(0, 22)]) AS f, embedding AS e FROM emb),
ap AS (SELECT call_id, chunk_idx, f, list_position([e[f + 1], e[f + 2], e[f + 3]], greatest(e[f + 1], e[f + 2], e[f + 3])) AS top, e[f + 2] AS m1, e[f + 3] AS m2 FROM ac),
ad AS (SELECT c.call_id, c.chunk_idx, avg(CASE WHEN c.top <> p.top THEN 1.0 ELSE 0.0 END) AS change_ratio, abs(avg(c.m1 - p.m1)) AS mass_delta_1, abs(avg(c.m2 - p.m2)) AS mass_delta_2
  FROM ap c JOIN ap p ON p.call_id = c.call_id AND p.chunk_idx = c.chunk_idx - 1 AND p.f = c.f GROUP BY c.call_id, c.chunk_idx)"""


def _features(spark, d):
    return speakers.boundary_features(standins.chunk_slots(spark, d), standins.activations(spark, d))


@query(
    "ag22_boundary_features",
    f"""WITH {BOUNDARY} SELECT call_id, chunk_idx, {", ".join(f"{rnd(c, 6)} AS {c}" for c in speakers.BOUNDARY_FEATURES)} FROM sf JOIN ad USING (call_id, chunk_idx)""",
)
def ag22(spark, d):
    return _features(spark, d).select("call_id", "chunk_idx", *[steady(F.col(c), 6).alias(c) for c in speakers.BOUNDARY_FEATURES])


@query("ud2_boundary_model")
def ud2(spark, d):
    emb = standins.embeddings(spark, d).select("call_id", F.col("seg_idx").alias("chunk_idx"), "speaker")
    prev = emb.select("call_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.col("speaker").alias("was"))
    truth = emb.join(prev, ["call_id", "chunk_idx"]).select(
        "call_id", "chunk_idx", F.when(F.col("speaker") != F.col("was"), 1.0).otherwise(0.0).alias("label")
    )
    rows = _features(spark, d).join(truth, ["call_id", "chunk_idx"])
    model = speakers.train_boundary_model(rows)
    return speakers.score_boundaries(rows, model).select("call_id", "chunk_idx", steady(F.col("boundary_score"), 4).alias("boundary_score"))


# The two-state recursion step by step, carrying both best paths.
@query(
    "wn12_sequence_decode",
    f"""WITH RECURSIVE {NEAREST}, it AS (SELECT call_id, seg_idx // 25 AS region, seg_idx, start_time_s,
      lag(end_time_s) OVER (PARTITION BY call_id, seg_idx // 25 ORDER BY seg_idx) AS pe, -d0 / (d0 + d1) AS e0, -d1 / (d0 + d1) AS e1,
      row_number() OVER (PARTITION BY call_id, seg_idx // 25 ORDER BY seg_idx) AS rn FROM ns),
    ic AS (SELECT *, CASE WHEN start_time_s < pe - 0.05 THEN 0 ELSE 0.08 END::DOUBLE AS st, CASE WHEN start_time_s < pe - 0.05 THEN 0 ELSE 0.10 END::DOUBLE AS sw FROM it),
    dp AS (SELECT call_id, region, rn, e0 AS s0, e1 AS s1, [0] AS p0, [1] AS p1 FROM ic WHERE rn = 1
      UNION ALL SELECT i.call_id, i.region, i.rn, greatest(s0 - st, s1 - sw) + e0, greatest(s0 - sw, s1 - st) + e1,
        CASE WHEN s0 - st >= s1 - sw THEN list_append(p0, 0) ELSE list_append(p1, 0) END, CASE WHEN s0 - sw >= s1 - st THEN list_append(p0, 1) ELSE list_append(p1, 1) END
      FROM dp JOIN ic i ON i.call_id = dp.call_id AND i.region = dp.region AND i.rn = dp.rn + 1),
    be AS (SELECT call_id, region, CASE WHEN s0 >= s1 THEN p0 ELSE p1 END AS path FROM dp QUALIFY row_number() OVER (PARTITION BY call_id, region ORDER BY rn DESC) = 1)
    SELECT i.call_id, i.region, i.seg_idx, 'spk_' || path[i.rn] AS speaker FROM it i JOIN be ON i.call_id = be.call_id AND i.region = be.region""",
)
def wn12(spark, d):
    items = _nearest(spark, d).select("call_id", F.floor(F.col("seg_idx") / 25).alias("region"), "seg_idx", "start_time_s", "end_time_s", "d0", "d1")
    return speakers.decode_regions(items)


DRIFT = f"""{EMB}, df AS (SELECT call_id, seg_idx, speaker, start_time_s, start_time_s + 2 * duration_s AS end_time_s, list_slice(embedding, 1, 22) AS a,
  list_slice(embedding, 22, 43) AS b, list_slice(embedding, 43, 64) AS c FROM emb)"""


def _drifts(spark, d):
    emb = standins.embeddings(spark, d)
    a, b, c = (F.slice("embedding", i * 21 + 1, 22) for i in range(3))
    return emb.select(
        "call_id",
        "seg_idx",
        "speaker",
        "start_time_s",
        (F.col("start_time_s") + 2 * F.col("duration_s")).alias("end_time_s"),
        (cosine_distance(a, b) / 3).alias("d_start_mid"),
        (cosine_distance(b, c) / 3).alias("d_mid_end"),
        (cosine_distance(a, c) / 3).alias("d_start_end"),
    )


@query(
    "wn16_split_drifting",
    f"""WITH {DRIFT}, x AS (SELECT *, end_time_s - start_time_s >= 3.5 AND ({cosd("a", "b")} / 3 > 0.3 OR {cosd("b", "c")} / 3 > 0.3) AND {cosd("a", "c")} / 3 > 0.3 * 0.7 AS split FROM df),
    y AS (SELECT *, unnest(CASE WHEN split THEN [0, 1] ELSE [0] END) AS part FROM x)
    SELECT call_id, seg_idx, part::BIGINT AS part, split AS is_split, round(CASE WHEN split AND part = 1 THEN (start_time_s + end_time_s) / 2 ELSE start_time_s END, 6) AS start_time_s,
      round(CASE WHEN split AND part = 0 THEN (start_time_s + end_time_s) / 2 ELSE end_time_s END, 6) AS end_time_s FROM y""",
)
def wn16(spark, d):
    out = turns.split_drifting(_drifts(spark, d))
    return out.select(
        "call_id", "seg_idx", "part", "is_split", F.round("start_time_s", 6).alias("start_time_s"), F.round("end_time_s", 6).alias("end_time_s")
    )


@query(
    "wn17_change_point",
    f"""WITH {DRIFT}, c AS (SELECT call_id, seg_idx, start_time_s + 1 AS at_s, {cosd("a", "b")} AS drift, speaker = 'spk_1' AS lone FROM df
      UNION ALL SELECT call_id, seg_idx, start_time_s + 2, {cosd("b", "c")}, false FROM df WHERE speaker <> 'spk_1'),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY drift DESC, at_s) = 1)
    SELECT call_id, seg_idx, CASE WHEN NOT lone OR drift > 0.95 THEN at_s END AS at_s, {rnd("drift", 6)} AS drift FROM b""",
)
def wn17(spark, d):
    rows = _drifts(spark, d)
    lone = F.col("speaker") == "spk_1"
    first = rows.select("call_id", "seg_idx", (F.col("start_time_s") + 1).alias("at_s"), (F.col("d_start_mid") * 3).alias("drift"), lone.alias("lone"))
    second = rows.where(~lone).select(
        "call_id", "seg_idx", (F.col("start_time_s") + 2).alias("at_s"), (F.col("d_mid_end") * 3).alias("drift"), F.lit(False).alias("lone")
    )
    out = turns.best_change_point(first.unionByName(second), ["call_id", "seg_idx"], 0.95)
    return out.select("call_id", "seg_idx", "at_s", steady(F.col("drift"), 6).alias("drift"))
