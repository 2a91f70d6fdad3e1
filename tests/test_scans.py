"""Blocked scans give the same result for any block size, and agree with plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions.numeric import block_of
from callweave.operators import align, monoid, notes, scans, signal, speakers, turns


def sequence(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, *range(9)])) for k in range(3) for i in range(40)]
    return sequence(spark, rows, "k int, i long, v long"), rows


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_matches_loop(series, block):
    df, rows = series
    runs = {
        "s": scans.Run("sum", F.col("v")),
        "m": scans.Run("max", F.col("v"), inclusive=False),
        "l": scans.Run("last", F.col("v"), inclusive=False),
        "f": scans.Run("first", F.col("v")),
    }
    got = {(r.k, r.i): (r.s, r.m, r.l, r.f) for r in scans.running(df, ["k"], ["i"], block_of(F.col("i"), block), runs).collect()}
    for k in range(3):
        seen = []
        for _, i, v in [r for r in rows if r[0] == k]:
            before = [x for x in seen if x is not None]
            seen.append(v)
            now = [x for x in seen if x is not None]
            want = (
                sum(now) if now else None,
                max(before) if before else None,
                before[-1] if before else None,
                now[0] if now else None,
            )
            assert got[(k, i)] == want


@pytest.mark.parametrize("block", [2, 1000])
def test_moments_match_numpy(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 3, 30)
    df = sequence(spark, [("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    out = scans.expanding_moments(df, ["k"], ["i"], block_of(F.col("i"), block), ["v"]).orderBy("i").collect()
    for i, r in enumerate(out):
        assert r.prior_n == i
        if i:
            assert r.v_mean == pytest.approx(x[:i].mean(), abs=1e-9)
            assert r.v_std == pytest.approx(x[:i].std(), abs=1e-7)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(2)
    data = {"hot": rng.integers(0, 400, 3000) / 7, "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = sequence(spark, rows, "k string, v double")
    out = scans.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95, "z": 1.0, "n": 0.0}, accuracy=accuracy).collect()
    for r in out:
        for name, p in (("a", 10), ("b", 50), ("c", 95), ("z", 100), ("n", 0)):
            assert r[name] == pytest.approx(np.percentile(data[r.k], p), abs=1e-9)


def merge_loop(rows, gap=0.5):
    out = []
    for spk, s, e in rows:
        if out and out[-1][0] == spk and s - out[-1][2] <= gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([spk, s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_merge_adjacent_matches_loop(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for call in range(6):
        t, seq = 0.0, []
        for i in range(25):
            t = round(t + rng.random(), 3)
            seq.append((rng.choice(["spk_0", "spk_1"]), t, round(t + rng.random() * 2, 3)))
            rows.append((call, i, *seq[-1]))
        want[call] = merge_loop(seq)
    df = sequence(spark, rows, "call_id long, seg_idx long, speaker string, start_time_s double, end_time_s double")
    got = turns.merge_adjacent(df, block_rows=block).orderBy("call_id", "seg_idx").collect()
    for call, seq in want.items():
        assert [(r.speaker, r.start_time_s, r.end_time_s) for r in got if r.call_id == call] == seq


def decode_loop(items):
    def emissions(d0, d1):
        t = d0 + d1
        return (-d0 / t, -d1 / t) if t >= 1e-8 else (0.0, 0.0)

    best = None
    n = len(items)
    for code in range(2**n):
        path = [(code >> i) & 1 for i in range(n)]
        score = 0.0
        for i, (s, e, d0, d1) in enumerate(items):
            score += emissions(d0, d1)[path[i]]
            if i and not s < items[i - 1][1] - 0.05:
                score -= 0.08 if path[i] == path[i - 1] else 0.10
        if best is None or score > best[0] + 1e-12:
            best = (score, path)
    return best


@pytest.mark.parametrize("block", [2, 3, 100])
def test_decoder_reaches_best_score(spark, block):
    rng = random.Random(block)
    rows, all_items = [], {}
    for call in range(5):
        items = []
        for i in range(8):
            items.append((i * 1.0, i + rng.choice([0.8, 1.5]), rng.random(), rng.random()))
            rows.append((call, 0, i, *items[-1]))
        all_items[call] = items
    df = sequence(spark, rows, "call_id long, region long, seg_idx long, start_time_s double, end_time_s double, d0 double, d1 double")
    got = speakers.decode_regions(df, block_rows=block).orderBy("call_id", "seg_idx").collect()
    for call, items in all_items.items():
        path = [int(r.speaker[-1]) for r in got if r.call_id == call]
        assert path == decode_loop(items)[1]


@pytest.mark.parametrize("block", [4, 1000])
def test_compressor_gain_ignores_blocks(spark, block):
    x = np.random.default_rng(3).normal(0, 1, 23)
    df = sequence(spark, [(1, i, float(v)) for i, v in enumerate(x)], "call_id long, sample_idx long, level double")
    got = signal.compressor_gain(df, 4, block_rows=block).orderBy("sample_idx").collect()
    full = np.sqrt(np.convolve(x * x, np.ones(4) / 4, "valid") + 1e-10)
    want = np.concatenate([[full[0]] * 2, full, [full[-1]]])
    assert [r.rms for r in got] == pytest.approx(list(want))


@pytest.mark.parametrize("block", [1, 1000])
def test_sentences_run_across_turns(spark, block):
    rows = [(1, 0, "hello there my"), (1, 1, "old friend. How are you doing"), (1, 2, "today? Fine thank you very much."), (1, 3, "ok."), (2, 0, "hi\nyo")]
    df = sequence(spark, rows, "call_id long, seg_idx long, text string")
    got = notes.call_sentences(df, block).orderBy("call_id", "sent_idx").collect()
    assert [r.sentence for r in got if r.call_id == 1] == [
        "hello there my old friend.", "How are you doing today?", "Fine thank you very much.",
    ]
    assert [r.sentence for r in got if r.call_id == 2] == ["hi", "yo"]


def test_band_power_equals_fft(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 2000) + np.sin(2 * np.pi * 50 * np.arange(2000) / 400)
    rows = [(1, b, [float(v) for v in x[b * 300 : (b + 1) * 300]]) for b in range(7)]
    df = sequence(spark, rows, "call_id long, block_idx long, samples array<double>")
    freqs = np.fft.rfftfreq(2000, 1 / 400)
    want = float(np.sum(np.abs(np.fft.rfft(x)[(freqs >= 48) & (freqs <= 52)]) ** 2))
    assert signal.band_power(df, 400.0, 300).first().band_power == pytest.approx(want, rel=1e-9)


def adversarial(n=4000):
    rng = np.random.default_rng(9)
    yield "sorted", np.arange(n, dtype=float)
    yield "reversed", np.arange(n, dtype=float)[::-1]
    yield "zigzag", np.where(np.arange(n) % 2 == 0, np.arange(n), -np.arange(n)).astype(float)
    yield "powers", 2.0 ** rng.integers(-1000, 1000, n)
    yield "two values", np.where(np.arange(n) < n * 0.1 - 1, -1.0, 1.0)
    yield "one value", np.full(n, 3.25)
    yield "outlier", np.r_[np.full(n - 1, 5.0), 1e300]
    for few in (1, 2, 3, 7):
        yield f"{few} rows", rng.normal(0, 1, few)


@pytest.mark.parametrize("accuracy", [3, 50, 10_000])
def test_quantiles_of_adversarial_data(spark, accuracy):
    """Exact for any accuracy of the sketch: a sketch that is off only reads another cell."""
    data = dict(adversarial())
    df = sequence(spark, [(k, float(v), -float(v)) for k, vs in data.items() for v in vs], "k string, v double, w double").repartition(6)
    wanted = {"v": {"v0": 0.0, "v10": 0.1, "v999": 0.999}, "w": {"w50": 0.5, "w100": 1.0}}
    out = {r.k: r for r in scans.column_quantiles(df, ["k"], wanted, accuracy=accuracy).collect()}
    assert set(out) == set(data)
    for k, v in data.items():
        for name, column, p in (("v0", v, 0), ("v10", v, 10), ("v999", v, 99.9), ("w50", -v, 50), ("w100", -v, 100)):
            assert out[k][name] == pytest.approx(np.percentile(column, p), rel=1e-12, abs=1e-300), (k, name)


def test_quantiles_of_missing_columns(spark):
    df = sequence(spark, [("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "k string, v double, w double")
    out = scans.column_quantiles(df, ["k"], {"v": {"x": 0.5}, "w": {"y": 0.5}}).collect()
    assert [tuple(r) for r in out] == [("a", 2.0, None)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_per_operator(spark, tmp_path):
    """Three scans for quantiles of any number of columns, two for a chain of islands; nothing is cached."""
    rows = spark.range(100).select((F.col("id") % 3).alias("call_id"), F.col("id").alias("seg_idx"), F.lit("a").alias("speaker"), F.rand(1).alias("start_time_s"), F.rand(2).alias("end_time_s"))
    rows.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    many = scans.column_quantiles(df, ["call_id"], {"start_time_s": {"a": 0.1, "b": 0.9}, "end_time_s": {"c": 0.5}})
    merged = turns.merge_adjacent(df)
    starts = F.col("p").isNull() | (F.col("p") > F.col("start_time_s"))
    chain = monoid.chained(df, ["call_id"], ["seg_idx"], F.lit(0), {"p": "end_time_s"}, starts, "n")
    for plan, most in ((plan_of(many), 9), (plan_of(merged), 4), (plan_of(chain), 2)):
        assert "InMemoryTableScan" not in plan and "CartesianProduct" not in plan
        assert plan.count("FileScan") <= most


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_chains_match_a_loop(spark, block):
    rng = random.Random(block)
    rows = [(k, i, rng.choice("ab"), rng.choice([0, 1, 5])) for k in ("x", "y") for i in sorted(rng.sample(range(60), 30))]
    df = sequence(spark, rows, "k string, i long, who string, gap int").repartition(3)
    starts = F.col("before").isNull() | (F.col("before") != F.col("who")) | (F.col("gap") > 3) | (F.col("i") - F.col("last") > 4)
    out = monoid.chained(df, ["k"], ["i"], block_of(F.col("i"), block), {"before": "who", "last": "i"}, starts, "n").collect()
    got = {(r.k, r.i): (r.before, r.last, r.n) for r in out}
    for k in ("x", "y"):
        last, n = None, 0
        for _, i, who, gap in [r for r in rows if r[0] == k]:
            n += last is None or last[1] != who or gap > 3 or i - last[0] > 4
            assert got[k, i] == (last and last[1], last and last[0], n)
            last = (i, who)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_merge_of_one_long_speaker(spark, block):
    """A monologue over many blocks: one long turn reaches over pauses of later ones, in other blocks."""
    rng = random.Random(block)
    rows, t = [], 0.0
    for i in range(40):
        t = round(t + rng.choice([0.2, 0.7, 2.0]), 3)
        rows.append((1, i, "a" if i not in (20, 33) else "b", t, round(t + rng.choice([0.1, 0.1, 6.0]), 3)))
    df = sequence(spark, rows, "call_id long, seg_idx long, speaker string, start_time_s double, end_time_s double")
    got = [(r.speaker, r.start_time_s, r.end_time_s) for r in turns.merge_adjacent(df, block_rows=block).orderBy("seg_idx").collect()]
    assert got == merge_loop([r[2:] for r in rows])


@pytest.mark.parametrize("bucket, block", [(3, 5), (600, 65_536)])
def test_swept_timeline_equals_seconds(spark, bucket, block):
    """Nested, overlapping and long turns: the stretches hold the second-by-second speakers, and there are few of them."""
    rng = random.Random(bucket)
    schema = "call_id long, seg_idx long, speaker string, start_time_s double, end_time_s double"

    def side(n):
        spans = [(c, i, rng.choice(["agent", "customer", "overlap"]), rng.random() * 60, rng.choice([0.2, 3, 9, 40]) * rng.random()) for c in (1, 2) for i in range(n)]
        return [(c, i, who, a, a + d) for c, i, who, a, d in spans]

    tables = {"truth": side(14), "predicted": side(9) + [(3, 0, "agent", 0.0, 86_400.0)]}
    dfs = {k: sequence(spark, v, schema) for k, v in tables.items()}
    horizon = sequence(spark, [(1, 50), (2, 10_000), (3, 80_000)], "call_id long, n_seconds long")
    rows = align.swept_timeline(dfs, horizon, bucket, block).collect()
    got = {(r.call_id, s): (r.truth, r.predicted) for r in rows if r.call_id < 3 for s in range(r.start_s, r.stop_s) if r.truth or r.predicted}
    want = {}
    for k, (name, turns_) in enumerate(tables.items()):
        for c, _, who, a, b in sorted(t for t in turns_ if t[0] < 3):
            for s in range(int(a // 1), min(int(np.ceil(b)), {1: 50, 2: 10_000}[c])):
                want[c, s] = (who, want.get((c, s), (None, None))[1]) if k == 0 else (want.get((c, s), (None, None))[0], who)
    assert got == want
    assert [(r.start_s, r.stop_s) for r in rows if r.call_id == 3] == [(0, 80_000)] and len(rows) < 2 * 2 * 23 + 2


def test_sentences_of_documents_are_ranked_in_their_row(spark):
    """The same scores as over rows of sentences, and no exchange."""
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(["Alpha", "beta", "caf\u00e9", "x_1", "...", "delta7", "\u0938\u093e\u0932\u093e"]) for _ in range(rng.randint(2, 9)))
    texts = [". ".join(say() for _ in range(rng.randint(1, 12))) + "." for _ in range(40)] + ["", None, " \n ", "short", "-----------. ===========!"]
    docs = sequence(spark, list(enumerate(texts)), "call_id long, text string")
    best = notes.best_sentences(docs)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
    split = notes.split_sentences(docs).select("call_id", F.size("sentences").alias("n_docs"), F.posexplode("sentences").alias("sent_idx", "sentence"))
    ranked = {}
    for r in notes.top_sentences(notes.sentence_scores(split)).orderBy("call_id", "rank").collect():
        ranked.setdefault(r.call_id, []).append(r.sent_idx)
    assert {r.call_id: r.best for r in best.collect() if r.best} == ranked
    empty = {r.call_id: r.summary for r in notes.summarize_documents(docs).collect()}
    assert [empty[40 + i] for i in range(4)] == [notes.NO_TRANSCRIPT] * 3 + ["short"]


def test_long_and_short_calls_are_summarized_alike(spark):
    rng = random.Random(8)
    said = lambda: " ".join(rng.choice(["Pay now", "the bill is late", "we call you again", "thanks"]) + rng.choice([".", "!", "", "?"]) for _ in range(6))
    turns = spark.createDataFrame([(c, i, said()) for c in range(8) for i in range(2 + 3 * c)] + [(90, 0, " "), (91, 0, "Yes.\nNo"), (92, 0, None)], "call_id long, seg_idx long, text string")
    of = lambda **kw: {r.call_id: r.summary for r in notes.summarize_calls(turns, 3, 4, **kw).collect()}
    each = of(row_sentences=0)
    assert len(each) == 11 and each[91] == "Yes. No" and each[90] == each[92] == notes.NO_TRANSCRIPT
    assert each == of() == of(row_sentences=15) == of(row_chars=300)
