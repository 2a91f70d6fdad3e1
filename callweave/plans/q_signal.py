"""Queries over signal quality and prosody."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions.numeric import steady
from callweave.operators import scans, signal
from callweave.plans import standins
from callweave.plans.oracle import SIG, rnd
from callweave.plans.registry import query

VAD = f"""{SIG}, fl AS (SELECT call_id, quantile_cont(rms, 0.1) AS noise_floor FROM fr GROUP BY call_id),
va AS (SELECT f.*, round(rms, 10) > round(noise_floor * 1.5, 10) AS speech, noise_floor FROM fr f JOIN fl ON f.call_id = fl.call_id)"""
FRAME_S, GAP_S = 0.5, 0.5


@query("ag13_speech_frames", f"WITH {VAD} SELECT call_id, frame_idx, speech FROM va")
def ag13(spark, d):
    return signal.speech_frames(standins.frames(spark, d)).select("call_id", "frame_idx", "speech")


@query(
    "ag13_silence_ratio",
    f"""WITH {VAD} SELECT call_id, count(*) AS n_frames, {rnd("avg(CASE WHEN speech THEN 0.0 ELSE 1.0 END)", 4)} AS silence_ratio FROM va GROUP BY call_id""",
)
def ag13s(spark, d):
    rows = standins.frames(spark, d)
    return signal.silence_ratio(signal.speech_frames(rows), rows.select("call_id").distinct())


REGIONS = f"""{VAD}, ac AS (SELECT call_id, frame_idx, lag(frame_idx) OVER (PARTITION BY call_id ORDER BY frame_idx) AS p FROM va WHERE speech),
rg AS (SELECT *, sum(CASE WHEN p IS NULL OR frame_idx - p > 1 + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY frame_idx) AS region FROM ac),
du AS (SELECT call_id, count(*) * 0.5::DOUBLE AS duration_s FROM fr GROUP BY call_id),
re AS (SELECT r.call_id, region - 1 AS region, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
  greatest(0.0, min(frame_idx) * 0.5::DOUBLE - 0.3::DOUBLE) AS start_s, least(min(duration_s), (max(frame_idx) + 1) * 0.5::DOUBLE + 0.3::DOUBLE) AS end_s
  FROM rg r JOIN du ON r.call_id = du.call_id GROUP BY r.call_id, region)"""


def _regions(spark, d):
    rows = standins.frames(spark, d)
    length = rows.groupBy("call_id").agg((F.count(F.lit(1)) * FRAME_S).alias("duration_s"))
    return signal.speech_regions(signal.speech_frames(rows), length, FRAME_S, GAP_S)


@query(
    "wn3_speech_regions",
    f"""WITH {REGIONS} SELECT call_id, region::BIGINT AS region, first_frame, last_frame, {rnd("start_s", 4)} AS start_s, {rnd("end_s", 4)} AS end_s FROM re""",
)
def wn3(spark, d):
    out = _regions(spark, d)
    return out.withColumns({"start_s": steady(F.col("start_s"), 4), "end_s": steady(F.col("end_s"), 4)})


@query(
    "wn4_chunk_plan",
    f"""WITH {REGIONS}, n AS (SELECT *, trunc(round(end_s * 100, 6))::BIGINT - trunc(round(start_s * 100, 6))::BIGINT AS n FROM re),
    c AS (SELECT *, unnest(range(0, (n - 1) // 500 + 1)) AS chunk FROM n WHERE n > 0)
    SELECT call_id, region::BIGINT AS region, chunk, {rnd("start_s + chunk * 5", 4)} AS offset_s, {rnd("least(500, n - chunk * 500) / 100.0", 4)} AS length_s
    FROM c WHERE least(500, n - chunk * 500) >= 100""",
)
def wn4(spark, d):
    out = signal.upload_chunks(_regions(spark, d), 100, 5)
    return out.withColumns({"offset_s": steady(F.col("offset_s"), 4), "length_s": steady(F.col("length_s"), 4)})


@query(
    "wn4_chunk_plan_ungated",
    f"""WITH {SIG}, n AS (SELECT call_id, count(*) * 50 AS n FROM fr GROUP BY call_id), c AS (SELECT *, unnest(range(0, (n - 1) // 500 + 1)) AS chunk FROM n)
    SELECT call_id, chunk, (chunk * 5)::DOUBLE AS offset_s, (least(500, n - chunk * 500) / 100.0)::DOUBLE AS length_s FROM c WHERE least(500, n - chunk * 500) >= 100""",
)
def wn4u(spark, d):
    rows = standins.frames(spark, d)
    length = rows.groupBy("call_id").agg((F.count(F.lit(1)) * FRAME_S).alias("duration_s"))
    return signal.upload_chunks(signal.whole_recording(length), 100, 5).drop("region")


QUIET = f"""{SIG}, qt AS (SELECT call_id, count(*) AS n_values, least(quantile_cont(energy, 0.15), quantile_cont(energy, 0.5) * 10 ** (-2.5)) AS threshold,
  quantile_cont(energy, 0.5) AS med FROM fr GROUP BY call_id),
qf AS (SELECT f.*, threshold, energy <= threshold AS quiet FROM fr f JOIN qt ON f.call_id = qt.call_id),
qi AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY frame_idx) - row_number() OVER (PARTITION BY call_id, quiet ORDER BY frame_idx) AS g FROM qf),
qr AS (SELECT call_id, g, count(*) AS run_len FROM qi WHERE quiet GROUP BY call_id, g),
qm AS (SELECT q.call_id, n_values, threshold, coalesce(max(run_len), 0) AS longest_run FROM qt q LEFT JOIN qr ON q.call_id = qr.call_id GROUP BY q.call_id, n_values, threshold)"""


@query(
    "wn5_sustained_silence",
    f"WITH {QUIET} SELECT call_id, n_values, {rnd('threshold', 6)} AS threshold, longest_run, longest_run >= 5 AS has_silence FROM qm",
)
def wn5(spark, d):
    out = signal.sustained_silence(standins.frames(spark, d))
    return out.withColumn("threshold", steady(F.col("threshold"), 6))


SNR = f"""{QUIET}, sf AS (SELECT q.* FROM qf q JOIN qm ON q.call_id = qm.call_id WHERE longest_run >= 5),
s6 AS (SELECT call_id, quantile_cont(energy, 0.6) AS p60 FROM sf WHERE NOT quiet GROUP BY call_id),
sp AS (SELECT s.call_id, avg(energy) FILTER (quiet) AS noise, coalesce(avg(energy) FILTER (NOT quiet AND energy >= p60), avg(energy)) AS speech
  FROM sf s LEFT JOIN s6 ON s.call_id = s6.call_id GROUP BY s.call_id),
sn AS (SELECT call_id, 10 * log10(greatest(speech, 1e-10) / greatest(coalesce(noise, 1e-10), 1e-10)) AS snr_db FROM sp)"""


@query("ag14_snr_by_silence", f"WITH {SNR} SELECT call_id, {rnd('snr_db', 4)} AS snr_db FROM sn")
def ag14(spark, d):
    return signal.snr(standins.frames(spark, d)).select("call_id", steady(F.col("snr_db"), 4).alias("snr_db"))


SPECTRA = """sw AS (SELECT vec_id // 50 AS call_id, (vec_id % 50) * 64 + generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
ss AS (SELECT call_id, max(pos) + 1 AS n FROM sw GROUP BY call_id),
sf AS (SELECT call_id, unnest(range(0, (n - 32) // 16 + 1)) AS frame_idx FROM ss),
sx AS (SELECT f.call_id, f.frame_idx, w.pos - f.frame_idx * 16 AS m, w.x, w.x * (0.5 - 0.5 * cos(2 * pi() * (w.pos - f.frame_idx * 16) / 31)) AS h
  FROM sf f JOIN sw w ON w.call_id = f.call_id AND w.pos BETWEEN f.frame_idx * 16 AND f.frame_idx * 16 + 31),
sb AS (SELECT call_id, frame_idx, k, sqrt(sum(h * cos(2 * pi() * k * m / 32)) ** 2 + sum(h * sin(2 * pi() * k * m / 32)) ** 2) AS mag
  FROM sx, (SELECT unnest(range(0, 17)) AS k) GROUP BY call_id, frame_idx, k),
sn AS (SELECT call_id, avg(f * f) AS noise FROM (SELECT call_id, k, quantile_cont(mag, 0.05) AS f FROM sb GROUP BY call_id, k) GROUP BY call_id),
sp AS (SELECT call_id, frame_idx, avg(x * x) AS power FROM sx GROUP BY call_id, frame_idx),
s6 AS (SELECT call_id, quantile_cont(power, 0.6) AS p60 FROM sp GROUP BY call_id),
sv AS (SELECT sp.call_id, avg(power) AS speech FROM sp JOIN s6 ON sp.call_id = s6.call_id WHERE power >= p60 GROUP BY sp.call_id)"""


@query(
    "ag14_snr_by_spectrum",
    f"""WITH {SPECTRA} SELECT sv.call_id, 'spectrum' AS path, {rnd("10 * log10(greatest(speech, 1e-10) / greatest(noise, 1e-10))", 4)} AS snr_db
    FROM sv JOIN sn ON sv.call_id = sn.call_id""",
)
def ag14s(spark, d):
    spectra = scans.shared(signal.frame_spectra(standins.vector_blocks(spark, d), 1600, 1600))
    frames = spectra.select("call_id", "frame_idx", F.col("power").alias("energy"))
    return signal.snr(frames, spectra).select("call_id", "path", steady(F.col("snr_db"), 4).alias("snr_db"))


CLIP = f"""{SIG}, ci AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY frame_idx) - row_number() OVER (PARTITION BY call_id, abs(level) >= 30 ORDER BY frame_idx) AS g FROM fr),
cr AS (SELECT call_id, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx, count(*) AS run_len FROM ci WHERE abs(level) >= 30 GROUP BY call_id, g HAVING count(*) >= 3)"""


@query("wn6_clipped_runs", f"WITH {CLIP} SELECT call_id, first_idx, last_idx, run_len FROM cr")
def wn6(spark, d):
    return signal.clipped_runs(standins.frames(spark, d), 30.0)


@query(
    "ag15_clipping_ratio",
    f"""WITH {CLIP}, n AS (SELECT call_id, count(*) AS n_samples FROM fr GROUP BY call_id), c AS (SELECT call_id, sum(run_len) AS k FROM cr GROUP BY call_id)
    SELECT n.call_id, n_samples, {rnd("coalesce(k, 0) / n_samples", 6)} AS clipping_ratio FROM n LEFT JOIN c ON n.call_id = c.call_id""",
)
def ag15(spark, d):
    return signal.clipping_ratio(standins.frames(spark, d), 30.0)


LOW = """n{x} AS (SELECT call_id, energy, row_number() OVER (PARTITION BY call_id ORDER BY energy) AS r, count(*) OVER (PARTITION BY call_id) AS n FROM {src}),
l{x} AS (SELECT call_id, avg(energy) AS power, avg(energy) FILTER (r <= greatest(1, floor(0.1 * n))) AS noise FROM n{x} GROUP BY call_id),
e{x} AS (SELECT call_id, power, noise, 10 * log10(power / noise) AS snr_db FROM l{x})"""


@query(
    "ag25_low_energy_snr",
    f"""WITH {SIG}, {LOW.format(x="a", src="fr")} SELECT call_id, {rnd("power", 4)} AS power, {rnd("noise", 4)} AS noise, {rnd("snr_db", 4)} AS snr_db FROM ea""",
)
def ag25(spark, d):
    out = signal.low_energy_snr(standins.frames(spark, d))
    return out.select("call_id", *[steady(F.col(c), 4).alias(c) for c in ("power", "noise", "snr_db")])


@query(
    "ag16_quality_grade",
    f"""WITH {SIG}, raw AS (SELECT call_id, energy + 1 AS energy FROM fr), pro AS (SELECT call_id, energy * energy + 1 AS energy FROM fr WHERE true),
    {LOW.format(x="b", src="raw")}, {LOW.format(x="c", src="pro")}
    SELECT b.call_id, {rnd("b.snr_db", 2)} AS snr_before_db, {rnd("c.snr_db", 2)} AS snr_after_db, {rnd("c.snr_db - b.snr_db", 2)} AS snr_improvement_db,
      CASE WHEN c.snr_db >= 15 OR (c.snr_db - b.snr_db >= 2 AND c.snr_db > 5) THEN 'PASS' ELSE 'FAIL' END AS audio_quality_grade
    FROM eb b JOIN ec c ON b.call_id = c.call_id""",
)
def ag16(spark, d):
    rows = standins.frames(spark, d)
    before = signal.low_energy_snr(rows.withColumn("energy", F.col("energy") + 1))
    after = signal.low_energy_snr(rows.withColumn("energy", F.col("energy") * F.col("energy") + 1))
    return signal.quality_grade(before, after)


HUM = """
hn{x} AS (SELECT call_id, count(*) AS n FROM fr GROUP BY call_id),
hb{x} AS (SELECT call_id, n, CASE WHEN least(floor(52.0 / (200.0 / n)), n // 2) >= ceil(48.0 / (200.0 / n))
  THEN range(ceil(48.0 / (200.0 / n))::BIGINT, least(floor(52.0 / (200.0 / n)), n // 2)::BIGINT + 1)
  ELSE [least(n // 2, greatest(0, ceil(50.0 / (200.0 / n) - 0.5)))::BIGINT] END AS ks FROM hn{x}),
hk{x} AS (SELECT call_id, n, unnest(ks) AS k FROM hb{x}),
hp{x} AS (SELECT f.call_id, k, sum({v} * cos(2 * pi() * ((k * frame_idx) % n) / n)) AS re, sum({v} * sin(2 * pi() * ((k * frame_idx) % n) / n)) AS im
  FROM fr f JOIN hk{x} h ON f.call_id = h.call_id GROUP BY f.call_id, k),
hw{x} AS (SELECT call_id, sum(re * re + im * im) AS p FROM hp{x} GROUP BY call_id)"""


@query(
    "ag17_band_power_drop",
    f"""WITH {SIG}, {HUM.format(x="a", v="level")}, {HUM.format(x="b", v="(level / (1 + level))")}
    SELECT a.call_id, {rnd("CASE WHEN b.p = 0 THEN 100 ELSE 10 * log10((a.p + 1e-10) / (b.p + 1e-10)) END", 4)} AS drop_db FROM hwa a JOIN hwb b ON a.call_id = b.call_id""",
)
def ag17(spark, d):
    rows = standins.frames(spark, d)
    raw = standins.blocks(rows, "level", 16)
    processed = standins.blocks(rows.withColumn("level", F.col("level") / (F.col("level") + 1)), "level", 16)
    out = signal.band_drop(raw, processed, 200.0, 16)
    return out.select("call_id", steady(F.col("drop_db"), 4).alias("drop_db"))


PROSODY = f"""{SIG}, pb AS (SELECT call_id, seg_idx, count(*) AS n_frames, count(*) FILTER (pitch_hz > 0) AS voiced_count,
  avg(pitch_hz) FILTER (pitch_hz > 0) AS pitch_mean, stddev_pop(pitch_hz) FILTER (pitch_hz > 0) AS pitch_std, min(pitch_hz) FILTER (pitch_hz > 0) AS pitch_min,
  max(pitch_hz) FILTER (pitch_hz > 0) AS pitch_max, quantile_cont(pitch_hz, 0.25) FILTER (pitch_hz > 0) AS pitch_p25, quantile_cont(pitch_hz, 0.75) FILTER (pitch_hz > 0) AS pitch_p75,
  avg(rms) AS rms_mean, stddev_pop(rms) AS rms_std, min(rms) AS rms_min, max(rms) AS rms_max, quantile_cont(rms, 0.25) AS rms_p25, quantile_cont(rms, 0.75) AS rms_p75,
  avg(zcr) AS speaking_rate_zcr, stddev_pop(zcr) AS zcr_std, max(zcr) AS zcr_max, min(frame_idx) AS f0 FROM fr GROUP BY call_id, seg_idx),
pk AS (SELECT call_id, seg_idx, frame_idx AS k FROM fr WHERE pitch_hz > 0 QUALIFY row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY pitch_hz DESC, frame_idx) = 1),
pp AS (SELECT f.call_id, f.seg_idx, avg(CASE WHEN rms < greatest(1e-4, 0.05 * rms_max) THEN 1.0 ELSE 0.0 END) AS pause_ratio FROM fr f JOIN pb ON f.call_id = pb.call_id AND f.seg_idx = pb.seg_idx GROUP BY f.call_id, f.seg_idx),
pv AS (SELECT call_id, seg_idx, abs(1 / pitch_hz - 1 / lag(pitch_hz) OVER (PARTITION BY call_id, seg_idx ORDER BY frame_idx)) AS d, 1 / pitch_hz AS t FROM fr WHERE pitch_hz > 0),
pj AS (SELECT call_id, seg_idx, CASE WHEN count(*) >= 2 THEN avg(d) / avg(t) ELSE 0.0 END AS jitter FROM pv GROUP BY call_id, seg_idx),
pl AS (SELECT call_id, seg_idx, rms, abs(rms - lag(rms) OVER (PARTITION BY call_id, seg_idx ORDER BY frame_idx)) AS d FROM fr),
ps AS (SELECT call_id, seg_idx, CASE WHEN count(*) >= 2 AND avg(rms) > 1e-10 THEN avg(d) / avg(rms) ELSE 0.0 END AS shimmer FROM pl GROUP BY call_id, seg_idx),
pa AS (SELECT pb.*, coalesce(jitter, 0.0) AS jitter, shimmer, pause_ratio, CASE WHEN voiced_count > 0 THEN k - f0 ELSE 0 END AS peak_f0_idx
  FROM pb LEFT JOIN pk USING (call_id, seg_idx) JOIN pp USING (call_id, seg_idx) LEFT JOIN pj USING (call_id, seg_idx) JOIN ps USING (call_id, seg_idx))"""
STATS = [
    "pitch_mean", "pitch_std", "pitch_min", "pitch_max", "pitch_p25", "pitch_p75", "rms_mean", "rms_std", "rms_min", "rms_max",
    "rms_p25", "rms_p75", "speaking_rate_zcr", "zcr_std", "zcr_max", "pause_ratio",
]


@query(
    "ag18_prosody",
    f"""WITH {PROSODY} SELECT call_id, seg_idx, n_frames, voiced_count, peak_f0_idx, {", ".join(f"coalesce({rnd(c, 6)}, 0.0) AS {c}" for c in STATS)},
      {rnd("voiced_count / n_frames", 6)} AS voiced_ratio, {rnd("rms_max / (rms_mean + 1e-10)", 6)} AS compression_ratio,
      CASE WHEN peak_f0_idx / n_frames < 0.33 THEN 'beginning' WHEN peak_f0_idx / n_frames < 0.66 THEN 'middle' ELSE 'end' END AS hif0_section FROM pa""",
)
def ag18(spark, d):
    out = signal.prosody(standins.frames(spark, d))
    return out.select(
        "call_id",
        "seg_idx",
        "n_frames",
        "voiced_count",
        "peak_f0_idx",
        *[steady(F.col(c), 6).alias(c) for c in (*STATS, "voiced_ratio", "compression_ratio")],
        "hif0_section",
    )


@query(
    "wn9_jitter_shimmer",
    f"WITH {PROSODY} SELECT call_id, seg_idx, {rnd('jitter', 8)} AS jitter, {rnd('shimmer', 8)} AS shimmer FROM pa",
)
def wn9(spark, d):
    out = signal.irregularity(standins.frames(spark, d))
    return out.select("call_id", "seg_idx", steady(F.col("jitter"), 8).alias("jitter"), steady(F.col("shimmer"), 8).alias("shimmer"))


@query(
    "wn13_moving_loudness",
    f"""WITH {SIG}, m AS (SELECT call_id, frame_idx, sqrt(avg(level * level) OVER w + 1e-10) AS r, count(*) OVER w AS n, count(*) OVER (PARTITION BY call_id) AS total
      FROM fr WINDOW w AS (PARTITION BY call_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    e AS (SELECT call_id, arg_min(r, frame_idx) FILTER (n = 7) AS head, arg_max(r, frame_idx) FILTER (n = 7) AS tail FROM m GROUP BY call_id),
    v AS (SELECT m.call_id, frame_idx, CASE WHEN n = 7 THEN r WHEN frame_idx < 3 THEN head ELSE tail END AS rms FROM m JOIN e ON m.call_id = e.call_id)
    SELECT call_id, frame_idx AS sample_idx, {rnd("rms", 6)} AS rms, {rnd("CASE WHEN rms > 10 ** 1.5 THEN (10 ** 1.5 / rms) ** (1 - 1 / 3.0::DOUBLE) ELSE 1 END", 6)} AS gain FROM v""",
)
def wn13(spark, d):
    rows = standins.frames(spark, d).select("call_id", F.col("frame_idx").alias("sample_idx"), "level")
    out = signal.compressor_gain(rows, 7, threshold_db=30.0)
    return out.select("call_id", "sample_idx", steady(F.col("rms"), 6).alias("rms"), steady(F.col("gain"), 6).alias("gain"))


WAVE = """wv AS (SELECT vec_id // 50 AS call_id, (vec_id % 50) * 64 + generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
wl AS (SELECT call_id, list(x ORDER BY pos) AS xs FROM wv GROUP BY call_id),
wf AS (SELECT call_id, unnest(range(0, (len(xs) - 48) // 16 + 1)) AS frame_idx, xs FROM wl WHERE len(xs) >= 48),
ww AS (SELECT call_id, frame_idx, list_slice(xs, frame_idx * 16 + 1, frame_idx * 16 + 48) AS f FROM wf)"""


@query(
    "ud3_frame_features",
    f"""WITH {WAVE}, c AS (SELECT call_id, frame_idx, f, list_transform(f, lambda v: v - list_avg(f)) AS z FROM ww),
    a AS (SELECT *, list_transform(range(3, 33), lambda l: list_sum(list_transform(range(1, 48 - l + 1), lambda i: z[i] * z[i + l]))) AS ac, list_sum(list_transform(z, lambda v: v * v)) AS a0 FROM c),
    b AS (SELECT *, list_max(ac) AS best, list_position(ac, list_max(ac)) + 2 AS lag FROM a)
    SELECT call_id, frame_idx, {rnd("sqrt(list_avg(list_transform(f, lambda v: v * v)))", 6)} AS rms,
      {rnd("len(list_filter(range(1, 48), lambda i: (f[i] < 0) <> (f[i + 1] < 0))) / 0.03", 4)} AS zcr,
      {rnd("CASE WHEN best / a0 >= 0.3 THEN 1600 / lag ELSE 0 END", 4)} AS pitch_hz FROM b""",
)
def ud3(spark, d):
    out = signal.frame_features(standins.vector_blocks(spark, d), 1600, 1600)
    return out.select(
        "call_id", "frame_idx", steady(F.col("rms"), 6).alias("rms"), steady(F.col("zcr"), 4).alias("zcr"), steady(F.col("pitch_hz"), 4).alias("pitch_hz")
    )


@query(
    "ud3_prosody_vector",
    None,
)
def ud3v(spark, d):
    frames = signal.frame_features(standins.vector_blocks(spark, d), 1600, 1600)
    frames = frames.withColumn("seg_idx", F.floor(F.col("frame_idx") / 50))
    stats = signal.prosody(frames, peak="peak").withColumn("duration_s", F.col("n_frames") * 0.01)
    vec = signal.prosody_vector(stats)
    return vec.select("call_id", "seg_idx", F.transform("vector", lambda x: steady(x, 6)).alias("vector"))


@query(
    "scan_exact_quantiles",
    """SELECT event_type, count(*) AS n_values, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def scan_quantiles(spark, d):
    out = scans.quantiles(standins.table(spark, d, "events"), ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p99": 0.99})
    return out.select("event_type", "n_values", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p99")])
