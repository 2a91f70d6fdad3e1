"""Small inputs with results worked out by hand."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callweave.functions import fusion, lexicon, rules, text
from callweave.operators import align, compliance, emotion, roles, scoring, signal, turns, verdicts
from callweave.plans.registry import QUERIES, load
from callweave.sources import files, store
from callweave.streaming import metrics, progress, sinks

SEG = "call_id string, seg_idx long, start_time_s double, end_time_s double, speaker string, text string"
WORDS = "call_id string, word_idx long, start double, end double, text string, probability double"


def seg(spark, rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], SEG)


def test_words_go_to_their_turns(spark):
    t = turns.merge_adjacent(seg(spark, [(0.0, 1.0, "spk_0", ""), (1.6, 2.6, "spk_0", "")]))
    w = spark.createDataFrame([("c", 0, 0.1, 0.4, "namaste", 0.9), ("c", 1, 1.8, 2.1, "ji", 0.8)], WORDS)
    out = align.turn_transcripts(align.align_words(w, t), t).orderBy("seg_idx").collect()
    assert [(r.text, r.duration_s) for r in out] == [("namaste", 1.0), ("ji", 1.0)]


def test_close_turns_merge(spark):
    out = turns.merge_adjacent(seg(spark, [(0.0, 1.0, "spk_0", ""), (1.2, 2.0, "spk_0", "")])).collect()
    assert [(r.start_time_s, r.end_time_s) for r in out] == [(0.0, 2.0)]


def test_turn_without_words_stays_and_ties_go_first(spark):
    t = seg(spark, [(0.0, 1.0, "spk_0", ""), (1.0, 2.0, "spk_1", ""), (5.0, 6.0, "spk_1", "")])
    w = spark.createDataFrame([("c", 0, 0.5, 1.5, "tie", 0.9), ("c", 1, 3.0, 3.5, "lost", 0.9)], WORDS)
    out = align.turn_transcripts(align.align_words(w, t, bucket_s=0.7), t).orderBy("seg_idx").collect()
    assert [(r.text, r.n_words, len(r.words)) for r in out] == [("tie", 1, 1), ("", 0, 0), ("", 0, 0)]


def test_long_turn_is_paged(spark):
    t = seg(spark, [(0.0, 100.0, "spk_0", "")])
    w = spark.createDataFrame([("c", i, i * 10.0, i * 10 + 1.0, f"w{i}", 1.0) for i in range(10)], WORDS)
    out = align.turn_transcripts(align.align_words(w, t), t, page_s=40.0).orderBy("page").collect()
    assert [r.text for r in out] == ["w0 w1 w2 w3", "w4 w5 w6 w7", "w8 w9"]
    assert {r.n_words for r in out} == {10}


def frames_of(spark, x, sr=1000, size=25):
    n = len(x) // size
    rms = np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(axis=1) + 1e-10)
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(rms)], "call_id long, frame_idx long, rms double")


def tone(seconds, sr=1000, level=0.5):
    return level * np.sin(2 * np.pi * 100 * np.arange(int(seconds * sr)) / sr)


@pytest.mark.parametrize(
    "parts, want",
    [
        ([0, 1, 0, 1], [(0.7, 1.6), (2.7, 1.3)]),
        ([0.0001, 0.5, -0.3, 0.5, -1.0], None),
    ],
)
def test_speech_chunks(spark, parts, want):
    noise = np.random.default_rng(0).normal(0, 1e-4, 1000)
    if want:
        x = np.concatenate([tone(1) if p else noise for p in parts])
    else:
        x = np.concatenate([noise, tone(0.5), noise[:300], tone(0.5), noise])
    f = frames_of(spark, x)
    d = spark.createDataFrame([(1, len(x) / 1000)], "call_id long, duration_s double")
    chunks = signal.upload_chunks(signal.speech_regions(signal.speech_frames(f, 3.0), d), 1000).orderBy("offset_s").collect()
    if want:
        assert [(r.offset_s, r.length_s) for r in chunks] == [(pytest.approx(o, abs=0.05), pytest.approx(n, abs=0.05)) for o, n in want]
    else:
        assert len(chunks) == 1 and chunks[0].length_s == pytest.approx(1.9, abs=0.1)


def test_long_region_is_cut_and_short_tail_dropped(spark):
    r = spark.createDataFrame([(1, 0, 7.7, 60.0), (2, 0, 7.7, 58.3), (3, 0, 1.0, 1.9)], "call_id long, region long, start_s double, end_s double")
    out = signal.upload_chunks(r, 1000).orderBy("call_id", "chunk").collect()
    assert [(x.call_id, x.offset_s, round(x.length_s, 3)) for x in out] == [(1, 7.7, 50.0), (1, 57.7, 2.3), (2, 7.7, 50.0)]


def test_silence_and_clipping(spark):
    quiet = signal.speech_frames(frames_of(spark, np.zeros(4000)))
    assert signal.silence_ratio(quiet).first().silence_ratio == 1.0
    half = np.concatenate([np.random.default_rng(1).normal(0, 0.001, 1000), tone(1)])
    assert signal.silence_ratio(signal.speech_frames(frames_of(spark, half), 3.0)).first().silence_ratio == pytest.approx(0.5, abs=0.1)
    wave = [(k, i, float(v)) for k, a in ((1, 0.5), (2, 1.5)) for i, v in enumerate(np.clip(tone(1, level=a, sr=5000), -0.99, 0.99))]
    out = {r.call_id: r.clipping_ratio for r in signal.clipping_ratio(spark.createDataFrame(wave, "call_id long, frame_idx long, level double"), 0.98, block_rows=50).collect()}
    assert out[1] == 0.0 and out[2] > 0.1


def test_pitch():
    t = np.arange(800) / 16000
    assert signal.pitches(np.sin(2 * np.pi * 200 * t)[None, :], 16000)[0] == pytest.approx(200, abs=5)
    assert signal.pitches(np.zeros((1, 800)), 16000)[0] == 0.0


DELTAS = "call_id string, seg_idx long, pitch_d double, energy_d double, rate_d double, jitter_d double, pause_r double, hif0_section string"


@pytest.mark.parametrize(
    "deltas, section, label, score",
    [
        ((2.0, 2.0, 1.5, 1.0, -2.0), "middle", "anger", 0.6063),
        ((-2.0, -2.0, -2.0, 0.5, 2.0), "beginning", "sad", 0.6583),
        ((0.0, 0.0, 0.0, 0.0, 0.0), "beginning", "neutral", 0.2283),
        ((0.0, 0.0, 0.0, 0.0, 0.0), "middle", "annoyed", 0.204),
    ],
)
def test_acoustic_profiles(spark, deltas, section, label, score):
    r = emotion.classify_acoustic(spark.createDataFrame([("c", 0, *deltas, section)], DELTAS)).first()
    assert (r.emotion, r.indeterminate) == (label, False)
    assert r.confidence == pytest.approx(score, abs=1e-4)


def test_baseline_needs_three_turns(spark):
    rows = [("c", i, "spk_0", 1.0, 150.0, 0.1, 900.0, 0.02, 0.1, "beginning") for i in range(4)] + [("c", 4, "spk_0", 0.2, 1.0, 1.0, 1.0, 1.0, 1.0, "end")]
    schema = "call_id string, seg_idx long, speaker string, duration_s double, pitch_mean double, rms_mean double, speaking_rate_zcr double, jitter double, pause_ratio double, hif0_section string"
    out = emotion.acoustic_emotions(spark.createDataFrame(rows, schema)).orderBy("seg_idx").collect()
    assert [r.indeterminate for r in out] == [True, True, True, False, True]
    assert out[3].confidence == pytest.approx(0.2283, abs=1e-4)


@pytest.mark.parametrize(
    "t, a, want",
    [
        (("neutral", 0.9), ("anger", 0.3, False), ("anger", "negative", 0.48, "fused", 0.3, 0.7)),
        (("joy", 0.8), ("sad", 0.5, False), ("joy", "positive", 0.8, "text", 1.0, 0.0)),
        (("joy", 0.3), ("anger", 0.68, False), ("anger", "negative", 0.68, "acoustic", 0.0, 1.0)),
        (("neutral", 0.0), ("neutral", 0.0, False), ("neutral", "neutral", 0.0, "fused", 0.55, 0.45)),
        (("joy", 0.2), ("anger", 0.8, True), ("anger", "negative", None, "fused", None, None)),
    ],
)
def test_fusion_rules(spark, t, a, want):
    schema = "text_emotion string, text_confidence double, acoustic_emotion string, acoustic_confidence double, acoustic_indeterminate boolean"
    r = fusion.fuse(spark.createDataFrame([(*t, *a)], schema)).first().fused
    for got, expect in zip(r, want, strict=True):
        assert expect is None or got == expect


def scan(spark, *texts, policy=compliance.DEFAULT_POLICY):
    df = spark.createDataFrame([("c", i, "agent", x) for i, x in enumerate(texts)], "call_id string, seg_idx long, speaker string, text string")
    return compliance.violations(df, policy).orderBy("seg_idx", "stage", "pos").collect()


def test_compliance_scan(spark):
    rows = scan(
        spark, "you idiots", "मैं कमीज पहनता हूं", "Threaten", "threaten", "share your otp", "तू कमीना है", "बहन के लौड़े", "grape", "ओटीपी बताओ"
    )
    got = {}
    for r in rows:
        got.setdefault(r.seg_idx, []).append((r.category, r.keyword, r.match_type, r.distance))
    assert got[0] == [("ABUSIVE", "idiot", "exact", 0), ("ABUSIVE", "idiot", "fuzzy", 1)]
    assert 1 not in got and 2 not in got
    assert got[3] == [("THREAT", "threaten", "threat", 0)]
    assert got[4] == [("RBI", "share your otp", "pattern", 0)]
    assert got[5] == [("ABUSIVE", "कमीना", "exact", 0)]
    assert [g[:3] for g in got[6]] == [("ABUSIVE", "लौड़े", "exact")]
    assert got[7] == [("THREAT", "rape", "threat", 0)]
    assert got[8] == [("RBI", "ओटीपी बताओ", "pattern", 0)]


def test_innocent_words_are_skipped(spark):
    plain = compliance.Policy(keywords=("stupid",), innocent=(), compounds=(), threats=(), regulatory={})
    spared = compliance.Policy(keywords=("stupid",), innocent=("stupic",), compounds=(), threats=(), regulatory={})
    assert [r.matched for r in scan(spark, "stupic stupix", policy=plain)] == ["stupic", "stupix"]
    assert [r.matched for r in scan(spark, "stupic stupix", policy=spared)] == ["stupix"]


def test_hints_never_hide_a_match(spark):
    samples = [
        "Unauthorized access", "DATA  BREACH", "confidential information", "share my PIN", "send money to that account", "bank account details",
        "ATM pin", "net banking password", "UPI pin", "paytm pin", "pre-existing disease", "NOT covered", "claim denied", "policy lapsed",
        "misrepresent", "false declaration", "FRAUDULENT", "without consent", "solicited call", "cooling-off period", "free look period",
        "agent commission", "mis-selling", "ſhare your pin", "mıs-sell", "kill you", "burnyou", "raping", "threat", "you will regret", "you'll be sorry",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    for p in lexicon.PATTERN_HINTS:
        fast = compliance.pattern_hits(F.col("text"), [p], compliance.folded(F.col("text")), compliance.has_devanagari(F.col("text")))
        slow = compliance.pattern_hits(F.col("text"), [p])
        assert df.where(F.array_join(fast, "|") != F.array_join(slow, "|")).count() == 0, p
    guarded = [p for ps in (lexicon.RBI_PATTERNS, lexicon.IRDAI_PATTERNS, lexicon.COMPOUND_PATTERNS, lexicon.THREAT_PATTERNS) for p in ps if lexicon.needs_devanagari(p)]
    assert len(guarded) >= 20 and not any(p.isascii() for p in guarded)


def test_scores(spark):
    schema = "call_id string, seg_idx long, speaker string, start_time_s double, end_time_s double, sentiment string, confidence double, violation_count long"
    rows = [("c", 0, "agent", 0.0, 40.0, "positive", 1.0, 2), ("c", 1, "agent", 40.0, 80.0, "negative", 1.0, 0), ("c", 2, "customer", 80.0, 100.0, "neutral", 1.0, 1)]
    r = scoring.component_scores(spark.createDataFrame(rows, schema)).first()
    assert (r.compliance, r.agent_stability, r.talk_ratio, r.customer_sentiment) == (60.0, 0.0, 40.0, 50.0)
    comp = spark.createDataFrame([("c", 50.0, 100.0, 75.0, 85.0, 100.0)], "call_id string, customer_sentiment double, compliance double, agent_stability double, intent_resolution double, talk_ratio double")
    g = scoring.grade_calls(comp).first()
    assert (g.qa_score, g.grade) == (77.8, "B")
    assert scoring.grade_calls(comp, scoring.weight_columns({"weights": {"compliance": 0.5}})).first().qa_score == 50.0


def test_blank_turns_and_guard(spark):
    t = seg(spark, [(0.0, 1.0, "a", "  "), (1.0, 2.0, "a", "hello"), (2.0, 3.0, "a", ""), (3.0, 4.0, "a", "namaste")])
    assert [r.seg_idx for r in turns.drop_blank(t).orderBy("seg_idx").collect()] == [1, 3]
    assert turns.empty_transcript_guard(t.where("seg_idx in (0, 2)")).first().audit_skipped == "no transcript"


def test_json_answers(spark):
    raw = '[{"index":0,"violations":[],"compliant":true},{"index":1'
    answers = spark.createDataFrame([("c", raw)], "call_id string, raw string")
    out = verdicts.verdicts_per_turn(seg(spark, [(0.0, 1.0, "agent", "x"), (1.0, 2.0, "agent", "y")]), answers).collect()
    assert [(r.violation_count, r.compliant) for r in out] == [(0, True), (0, True)]
    assert verdicts.parse_verdicts(answers).count() == 1
    r = roles.parse_role_answer(spark.createDataFrame([('{"spk_0":"agent","spk_1":"uncertain"}', ["spk_0", "spk_1"])], "raw string, speakers array<string>")).first()
    assert r.roles == {"spk_0": "agent", "spk_1": "customer"}


def test_store(spark):
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    config = {**lexicon.STORE_CONFIG, "language": "hi"}
    word = [(0.0, 0.4, "a", 1.0)]
    at = pd.Timestamp("2026-01-30").to_pydatetime()
    old = pd.Timestamp("2025-12-01").to_pydatetime()
    rows = [("same", "hi", config, at, word), ("model", "hi", {**config, "model": "x"}, at, word), ("old", "hi", config, old, word), ("empty", "hi", config, at, None), ("lang", "en", {**config, "language": "en"}, at, word)]
    from callweave.model import TRANSCRIPT_STORE

    table = spark.createDataFrame(rows, TRANSCRIPT_STORE)
    asked = spark.createDataFrame([(k, "hi") for k in ("same", "model", "old", "empty", "lang")], "content_sha1 string, lang string")
    out = store.store_lookup(asked, table, now)
    assert [r.content_sha1 for r in out.where("words is not null").collect()] == ["same"]
    assert store.store_misses(out).count() == 4
    assert store.store_rows(table.select("content_sha1", "lang", "words"), now).count() == 4


def test_upsert_and_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1, '{"duration_s":3}'), ("b", 1, "{}")], "filename string, version long, doc string")
    store.upsert(spark, one, path, buckets=4)
    store.upsert(spark, spark.createDataFrame([("a", 2, '{"duration_s":4}')], one.schema), path, buckets=4)
    got = store.read_results(spark, path)
    assert sorted((r.filename, r.version) for r in got.collect()) == [("a", 2), ("b", 1)]
    r = store.stage_slice(got.where("filename = 'b'"), "denoise").first()
    assert (r.duration_s, r.denoise_metrics) == (None, None)


EVENTS = "filename string, stage_id string, status string, time_s double, event_time timestamp, seq long, error string"


def stage_events(spark, rows):
    base = pd.Timestamp("2026-01-01")
    return spark.createDataFrame([("f", s, k, t, (base + pd.Timedelta(minutes=i)).to_pydatetime(), i, "no disk" if k == "failed" else None) for i, (s, k, t) in enumerate(rows)], EVENTS)


def test_progress_states(spark):
    steps = [(None, "created", 0.0), ("denoise", "running", 0.0), ("denoise", "done", 1.5)]
    got = [progress.progress_batch(stage_events(spark, steps[:n])).first() for n in (1, 2, 3)]
    assert [(g.status, g.percent) for g in got] == [("queued", 0), ("running", 0), ("running", 11)]
    assert got[2].stages == "denoise:done:1.5"
    done = progress.progress_batch(stage_events(spark, [*steps, (None, "finished", 9.5)])).first()
    failed = progress.progress_batch(stage_events(spark, [*steps, (None, "failed", 0.0)])).first()
    assert (done.status, done.percent, failed.status, failed.percent) == ("completed", 100, "error", 11)
    assert (done.error, done.time_s, failed.error) == (None, 9.5, "no disk") and got[2].time_s is None
    assert progress.progress_batch(stage_events(spark, steps[1:])).count() == 0


def test_folding_is_order_free():
    base = pd.Timestamp("2026-01-01")
    kinds = [("x", "done"), (None, "created"), ("denoise", "running"), ("denoise", "done"), ("stt", "running"), (None, "failed")]
    pdf = pd.DataFrame([(s, k, 2.0, base + pd.Timedelta(minutes=i), i, "no disk" if k == "failed" else None) for i, (s, k) in enumerate(kinds)], columns=["stage_id", "status", "time_s", "event_time", "seq", "error"])
    straight = progress.snapshot("f", progress.fold_events({}, pdf))
    state = {}
    for i in (5, 2, 0, 4, 3, 1):
        state = json.loads(json.dumps(progress.fold_events(state, pdf.iloc[[i]])))
    assert progress.snapshot("f", state) == straight
    assert straight["error"] == "no disk" and straight["time_s"] == 2.0
    assert straight["status"] == "error" and straight["n_done"] == 1 and straight["current_stage"] == "stt"


def test_late_events_are_dropped_by_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    hours = [(0, "2026-03-01"), (1, "2026-03-02"), (2, "2026-03-03"), (3, "2026-01-01")]
    for i, day in hours:
        rows = [("f", "stt", "done", 1.0, pd.Timestamp(day).to_pydatetime(), i, None)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    sinks.append_stream(metrics.stage_latency(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    got = {r.window_start.isoformat()[:10] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "2026-03-01" in got and "2026-01-01" not in got


def test_truth_table_and_files(spark, tmp_path):
    p = tmp_path / "truth.md"
    p.write_text("| Timestamp | Speaker |\n| 0:01 - 0:02 | Agent |\n\n| Timestamp | Speaker | Text |\n|---|---|---|\n| 0:05 – 0:07 | **Agent** | hi |\n| 1:00:30 - 10:00:05 | customer | x |\n| bad | agent |\n")
    got = files.truth_file(spark, str(p)).orderBy("line_no").collect()
    assert [(r.start_time_s, r.end_time_s, r.speaker) for r in got] == [(5.0, 7.0, "agent"), (60.3, 36005.0, "customer")]
    for name in ("b.wav", "a.mp3", "a_denoised.wav", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.filename for r in files.call_catalogue(spark, str(tmp_path)).collect()) == ["a.mp3", "b.wav"]
    assert {r.content_sha1 for r in files.with_fingerprint(spark, str(tmp_path)).collect()} == {"11f6ad8ec52a2984abaafd7c3b516503785c2072"}


def test_tokens_and_shapes(spark):
    df = spark.createDataFrame([("कमीज AB_c हूं।",)], "t string")
    r = df.select(text.tokens(F.col("t")).alias("a"), text.tokens_with_marks(F.col("t")).alias("b"), rules.percent_done(F.lit(1)).alias("p")).first()
    assert r.a[:2] == ["कम", "ज"] and r.b == ["कमीज", "ab_c", "हूं।"] and r.p == 11


def test_vector_has_32_finite_numbers(spark):
    load()
    rows = QUERIES["ud3_prosody_vector"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(len(r.vector) == 32 and all(math.isfinite(v) for v in r.vector) for r in rows)


def test_signal_operators_take_text_call_ids(spark):
    wave = [float(x) for x in np.sin(2 * np.pi * 200 * np.arange(1600) / 1600)]
    blocks = spark.createDataFrame([("a", 0, wave[:800]), ("a", 1, wave[800:])], "call_id string, block_idx long, samples array<double>")
    rows = signal.frame_features(blocks, 1600, 800).collect()
    assert {r.call_id for r in rows} == {"a"} and len(rows) == 98
    assert signal.band_power(blocks, 1600, 800).collect()[0].call_id == "a"
    assert {r.call_id for r in signal.frame_spectra(blocks, 1600, 800).collect()} == {"a"}
    with pytest.raises(ValueError):
        signal.frame_features(blocks, 1600, 40)


def test_a_newer_stored_entry_replaces_an_older_one(spark):
    from pyspark.sql import functions as F

    from callweave.sources import store

    word = "array(named_struct('start', 0D, 'end', 1D, 'text', 'x', 'probability', 1D))"
    rows = spark.createDataFrame([(10, "en"), (20, "xx")], "day int, config_lang string").select(
        F.lit("h").alias("content_sha1"),
        F.lit("en").alias("lang"),
        store.expected_config(F.col("config_lang")).alias("config"),
        F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
        F.expr(word).alias("words"),
    )
    asked = spark.createDataFrame([("h", "en")], "content_sha1 string, lang string")
    now = F.lit("2024-01-21").cast("timestamp")
    assert store.store_lookup(asked, rows, now).first().words is None
    assert store.store_lookup(asked, rows.where("day(created_at) = 10"), now).first().words is not None


def event_rows(spark, rows, path):
    """Append (filename, stage_id, status, minute, seq) as stage events."""
    base = pd.Timestamp("2026-01-01")
    out = [(f, g, k, 1.0, (base + pd.Timedelta(minutes=m)).to_pydatetime(), q, None) for f, g, k, m, q in rows]
    spark.createDataFrame(out, EVENTS).coalesce(1).write.mode("append").parquet(path)


def run_snapshots(spark, src, out, ckpt, ttl_s):
    from callweave.streaming import metrics, sinks

    metrics.use_rocksdb(spark)
    snaps = progress.progress_stream(spark.readStream.schema(EVENTS).parquet(src), ttl_s)
    sinks.upsert_stream(snaps, out, ckpt, ["filename"], ["as_of", "as_of_seq"]).awaitTermination()
    return {r.filename: r for r in store.read_results(spark, out).collect()}


def test_job_state_expires_after_its_last_change(spark, tmp_path):
    import time

    for ttl_s, expected in ((1, "queued"), (3600, "running")):
        src, out, ckpt = (str(tmp_path / f"{n}{ttl_s}") for n in ("in", "out", "ckpt"))
        event_rows(spark, [("f", None, "created", 0, 0)], src)
        assert run_snapshots(spark, src, out, ckpt, ttl_s)["f"].status == "queued"
        time.sleep(2)
        # A stage of a job that is forgotten is unknown and changes nothing.
        event_rows(spark, [("f", "stt", "running", 1, 1)], src)
        assert run_snapshots(spark, src, out, ckpt, ttl_s)["f"].status == expected


def test_durations_span_micro_batches(spark, tmp_path):
    from callweave.streaming import metrics, sinks

    metrics.use_rocksdb(spark)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for rows in ([("f", "stt", "running", 0, 0)], [("f", "stt", "done", 600, 1), ("f", "stt", "done", 610, 2)]):
        event_rows(spark, rows, src)
        stream = metrics.stage_durations_stream(spark.readStream.schema(EVENTS).parquet(src))
        sinks.append_stream(stream, out, ckpt).awaitTermination()
    assert [(r.seq, r.elapsed_s) for r in spark.read.parquet(out).collect()] == [(1, 36000.0)]


def test_events_of_a_stage_are_paired_as_rows():
    from pyspark.sql import Row

    rows = [Row(status=k, at=t, seq=q) for k, t, q in (("done", 9, 4), ("error", 8, 3), ("running", 7, 2), ("done", 5, 1), ("done", 5, 2))]
    assert metrics.pair_events(("running", 1), rows) == (("done", 9), [(1, 1, 5), (4, 7, 9)])
    assert metrics.pair_events(None, rows[3:]) == (("done", 5), [])


def test_a_call_is_new_only_once(spark, tmp_path):
    from callweave.streaming import sinks

    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "content_sha1 string, event_time timestamp"
    for day, names in ((1, "aab"), (20, "bc"), (90, "ac")):
        rows = [(n, (pd.Timestamp(2026, 1, 1) + pd.Timedelta(days=day)).to_pydatetime()) for n in names]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sinks.append_new_stream(spark.readStream.schema(schema).parquet(src), out, ckpt).awaitTermination()
    assert sorted(r.content_sha1 for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_near_misses_compare_only_keywords_a_script_can_reach(spark):
    """A keyword with more Devanagari letters than edits is not compared with texts without any; one with fewer is."""
    policy = compliance.Policy(keywords=("\u0938\u093e\u0932\u093e", "bastard", "stupi\u0926"), innocent=("stupia",), compounds=(), threats=(), regulatory={})
    latin = str(compliance._reach_table(policy, False))
    assert "bastard" in latin and "stupi" in latin and "\u0938" not in latin
    assert "\u0938" in str(compliance._reach_table(policy, True))
    rows = [("a", 0, "agent", "bastart stupid stupia"), ("b", 0, "agent", "bastart \u0938\u093e\u0932\u0947\u0902\u0964"), ("c", 0, "agent", None)]
    docs = spark.createDataFrame(rows, "call_id string, seg_idx long, speaker string, text string")
    got = sorted((r.call_id, r.matched, r.keyword, r.distance, r.pos) for r in compliance.near_misses(docs, policy).collect())
    assert got == [("a", "bastart", "bastard", 1, 0), ("a", "stupid", "stupi\u0926", 1, 1), ("b", "bastart", "bastard", 1, 0)]


def test_reviews_are_merged_with_one_scan_of_the_texts(spark, tmp_path):
    load()
    out = QUERIES["jn11_review_merge"](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in out._jdf.queryExecution().toString()


def test_equal_sums_of_weights_are_a_tie(spark):
    """Seventy times 0.1 and once 7.0 weigh the same; the label that comes first in the alphabet wins."""
    scorer = emotion.lexicon_scorer({"a": ("sadness", 7.0), "b": ("joy", 0.1)}, ("call_id",))
    rows = [(1, "a" + " b" * 70), (2, "b " * 70 + "a"), (3, "b " * 69 + "a")]
    got = {r.call_id: (r.label, round(r.confidence, 6)) for r in scorer(spark.createDataFrame(rows, "call_id long, scoring_text string")).collect()}
    assert got == {1: ("joy", 0.5), 2: ("joy", 0.5), 3: ("sadness", round(1 / (1 + math.exp(-0.1)), 6))}


@pytest.mark.parametrize("low, high, at", [(25, 35, 39), (26, 26, 39), (50, 70, 78), (57, 87, 90)])
def test_a_frame_right_at_the_threshold_is_no_speech(spark, tmp_path, low, high, at):
    """Of twelve values the 10th percentile is low + (high - low) / 10, and 1.5 times that the third number, by hand."""
    import datetime

    import duckdb

    from callweave.plans.registry import ORACLES

    start = datetime.datetime(2024, 1, 1)
    values = [low, low, high, *[at] * 8, at + 1]
    rows = [(i, start + datetime.timedelta(seconds=i), 1, "view", v / 100.0, "") for i, v in enumerate(values)]
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    pdf.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    load()
    got = [r.speech for r in QUERIES["ag13_speech_frames"](spark, str(tmp_path)).orderBy("frame_idx").collect()]
    assert got == [False] * 11 + [True]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    assert [r[2] for r in sorted(con.execute(ORACLES["ag13_speech_frames"]).fetchall())] == got


def test_streams_read_a_table_of_one_file_and_of_many(spark, tmp_path):
    from callweave.plans import q_streams

    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    folder = tmp_path / "one"
    folder.mkdir()
    docs.toPandas().to_parquet(folder / "documents.parquet")
    docs.where("doc_id = 0").toPandas().to_parquet(folder / "documents.parquet.old")
    for d in ("many", "one"):
        assert q_streams.st5(spark, str(tmp_path / d)).count() == 3


def test_progress_folds_plain_rows_in_any_order():
    """A file's few events of a micro-batch were a data frame each; a null time of a done stage became nan."""
    from collections import namedtuple

    row = namedtuple("Event", "at seq status stage_id time_s error")
    events = [
        row(1, 1, "done", "s1", 9.0, None), row(2, 1, "created", None, None, None), row(3, 1, "running", "s1", 1.0, None),
        row(4, 2, "done", "s1", None, None), row(4, 1, "error", "s1", 2.0, None), row(5, 1, "done", "s2", 3.5, None), row(6, 1, "failed", "s2", 7.0, "E6"),
    ]
    for order in (events, events[::-1], events[3:] + events[:3]):
        state = progress.fold_rows({}, order[:2])
        got = progress.snapshot("f", progress.fold_rows(json.loads(json.dumps(state)), order[2:]))
        assert (got["status"], got["error"], got["time_s"], got["n_done"], got["as_of_seq"]) == ("error", "E6", 7.0, 2, 1)
        assert got["stages"] == "s1:done:0.0,s2:done:3.5" and got["current_stage"] == "s2"


def test_letters_are_swapped_without_a_string_for_each(spark):
    """``translate`` makes a string of every character; it took most of the time of long texts."""
    from callweave.functions.text import swapped
    from callweave.operators.compliance import folded

    rows = [("a b  \u00e9 \u017f\u0131\u0130 \U0001f600 ",), ("",), (None,), ("plain",), ("\u00a0 ",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", swapped(F.col("t"), {" ": "\u00a0"}).alias("x"), folded(F.col("t")).alias("y"))
    assert "translate" not in got._jdf.queryExecution().toString()
    for t, x, y in got.collect():
        assert x == (None if t is None else t.replace(" ", "\u00a0"))
        assert y == (None if t is None else t.translate({0x17F: "s", 0x131: "i", 0x130: "i"}).lower())


def test_spectra_of_short_calls_are_summed_up_in_a_row(spark):
    rows = [(c, i, float((i * 37 + c) % 23), [float((i * k + c) % 19) for k in (3, 5, 7)]) for c in range(4) for i in range(1 + 40 * c)]
    rows += [(8, 0, 1.0, [2.0, None]), (8, 1, 3.0, [4.0, 5.0]), (9, 0, 2.0, [])]
    spectra = spark.createDataFrame(rows, "call_id long, frame_idx long, power double, mags array<double>")
    short = {r.call_id: r.snr_db for r in signal.snr_by_spectrum(spectra).collect()}
    scans = {r.call_id: r.snr_db for r in signal.snr_by_spectrum(spectra, row_frames=0).collect()}
    some = {r.call_id: r.snr_db for r in signal.snr_by_spectrum(spectra, row_frames=50).collect()}
    assert sorted(short) == sorted(scans) == sorted(some) == [0, 1, 2, 3, 8]
    assert short == pytest.approx(scans) and some == pytest.approx(scans)
