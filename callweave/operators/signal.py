"""Signal quality and prosody from frame tables and sample blocks.

Frames are rows (call_id, frame_idx, ...). Positions are dense, so runs, neighbours and moving
windows work block by block (see scans). Only pitch and spectra need NumPy; they run on Arrow
batches of one-second blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.numeric import block_of, decibels, steady
from callweave.functions.rules import peak_section
from callweave.functions.vectors import total
from callweave.operators.monoid import chained
from callweave.operators.scans import BLOCK, BLOCK_ROWS, column_quantiles, previous, quantiles, quiet_runs, shared, with_halo

CALL = ["call_id"]
#: Spectra of up to so many frames of a call are held in one row.
ROW_FRAMES = 2000


# --- speech activity ---------------------------------------------------------------------------
def speech_frames(frames: DataFrame, multiplier: float = 1.5, rms: str = "rms") -> DataFrame:
    """Flag frames louder than ``multiplier`` times the call's 10th percentile.

    Both sides are compared to 10 digits: a frame right at the threshold is no speech, however the percentile's interpolation rounds.
    """
    floor = quantiles(frames, CALL, rms, {"noise_floor": 0.10}).drop("n_values")
    louder = F.round(F.col(rms).cast("double"), 10) > F.round(F.col("noise_floor") * F.lit(float(multiplier)), 10)
    return frames.join(floor, "call_id").withColumn("speech", louder)


def frame_rms(samples: Column) -> Column:
    """Root mean square of an array of samples, as used for speech activity."""
    return F.sqrt(total(F.transform(samples, lambda x: x * x)) / F.size(samples) + 1e-10)


def silence_ratio(flagged: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Share of frames without speech; 1 for a call that has no frame."""
    out = flagged.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        steady(F.avg(F.when(F.col("speech"), 0.0).otherwise(1.0)), 4).alias("silence_ratio"),
    )
    if calls is None:
        return out
    return calls.select("call_id").join(out, "call_id", "left").select(
        "call_id",
        F.coalesce("n_frames", F.lit(0).cast("long")).alias("n_frames"),
        F.coalesce("silence_ratio", F.lit(1.0)).alias("silence_ratio"),
    )


def speech_regions(
    flagged: DataFrame,
    durations: DataFrame,
    frame_s: float = 0.025,
    gap_s: float = 0.5,
    pad_s: float = 0.3,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Stretches of speech frames, bridging short gaps, padded and clamped to the recording.

    ``durations`` has (call_id, duration_s).
    """
    gap_frames = max(1, round(gap_s / frame_s))
    block = block_of(F.col("frame_idx"), block_rows)
    active = flagged.where("speech").select("call_id", "frame_idx")
    opens = F.col("__prev").isNull() | (F.col("frame_idx") - F.col("__prev") > gap_frames + 1)
    active = chained(active, CALL, ["frame_idx"], block, {"__prev": "frame_idx"}, opens, "region")
    spans = active.groupBy("call_id", "region").agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame")
    )
    return spans.join(durations, "call_id").select(
        "call_id",
        (F.col("region") - 1).alias("region"),
        "first_frame",
        "last_frame",
        F.greatest(F.lit(0.0), F.col("first_frame") * F.lit(frame_s) - pad_s).alias("start_s"),
        F.least(F.col("duration_s"), (F.col("last_frame") + 1) * F.lit(frame_s) + pad_s).alias("end_s"),
    )


def upload_chunks(regions: DataFrame, sample_rate: int, chunk_s: int = 50) -> DataFrame:
    """Cut regions into pieces of at most ``chunk_s``; a piece under one second is left out."""
    first = (F.round(F.col("start_s") * sample_rate, 6)).cast("long")
    last = (F.round(F.col("end_s") * sample_rate, 6)).cast("long")
    step = chunk_s * sample_rate
    rows = regions.withColumn("__n", last - first).where("__n > 0")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / step))))
    size = F.least(F.lit(step), F.col("__n") - F.col("chunk") * step)
    return (
        rows.withColumn("__size", size)
        .where(F.col("__size") >= sample_rate)
        .select(
            "call_id",
            "region",
            "chunk",
            (F.col("start_s") + F.col("chunk") * chunk_s).alias("offset_s"),
            (F.col("__size") / sample_rate).alias("length_s"),
        )
    )


def whole_recording(durations: DataFrame) -> DataFrame:
    """One region per call: the planner's input when gating is switched off."""
    return durations.select(
        "call_id", F.lit(0).cast("long").alias("region"), F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")
    )


# --- noise -------------------------------------------------------------------------------------
def sustained_silence(frames: DataFrame, min_run: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per call: quiet threshold, longest run of quiet frames, and whether it counts as silence.

    Quiet means at or below both the 15th percentile and 25 dB under the median.
    """
    q = quantiles(frames, CALL, "energy", {"p15": 0.15, "median": 0.50})
    q = q.withColumn("threshold", F.least("p15", F.col("median") * F.lit(10.0**-2.5)))
    joined = frames.join(q.where("median > 0").select("call_id", "threshold"), "call_id")
    runs = quiet_runs(joined, CALL, "frame_idx", block_rows, F.col("energy") <= F.col("threshold"))
    longest = runs.groupBy("call_id").agg(F.max("run_len").alias("longest_run"))
    out = q.join(longest, "call_id", "left").withColumn(
        "longest_run", F.coalesce("longest_run", F.lit(0).cast("long"))
    )
    return out.select(
        "call_id",
        "n_values",
        F.when(F.col("median") > 0, F.col("threshold")).otherwise(0.0).alias("threshold"),
        "longest_run",
        ((F.col("longest_run") >= min_run) & (F.col("median") > 0)).alias("has_silence"),
    )


def snr_by_silence(frames: DataFrame, silence: DataFrame) -> DataFrame:
    """Speech over noise power for calls with sustained silence.

    Noise is the mean of the quiet frames, speech the mean of the others from their 60th percentile.
    """
    marked = frames.join(silence.where("has_silence").select("call_id", "threshold"), "call_id").withColumn(
        "quiet", F.col("energy") <= F.col("threshold")
    )
    p60 = quantiles(marked.where("not quiet"), CALL, "energy", {"p60": 0.60}).drop("n_values")
    joined = marked.join(p60, "call_id", "left")
    loud = ~F.col("quiet") & (F.col("energy") >= F.col("p60"))
    power = joined.groupBy("call_id").agg(
        F.avg(F.when(F.col("quiet"), F.col("energy"))).alias("noise"),
        F.coalesce(F.avg(F.when(loud, F.col("energy"))), F.avg("energy")).alias("speech"),
    )
    return power.select(
        "call_id", decibels(F.col("speech"), F.coalesce("noise", F.lit(1e-10))).alias("snr_db"), F.lit("silence").alias("path")
    )


def _quantile_of(values: np.ndarray, p: float) -> np.ndarray:
    """The quantile of each column, interpolated as in ``quantiles``."""
    ordered, rank = np.sort(values, axis=0), p * (len(values) - 1)
    a, b = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
    return a + (b - a) * (rank - np.floor(rank))


def _spectrum_in_rows(spectra: DataFrame) -> DataFrame:
    """(call_id, speech, noise) of calls whose frames fit in a row; no bin of a frame becomes a row of its own."""

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            speech, noise = [], []
            for powers, mags in zip(pdf["powers"], pdf["mags"]):
                power = np.asarray(powers, float)
                speech.append(power[power >= _quantile_of(power, 0.60)].mean())
                noise.append((_quantile_of(np.array([np.asarray(m, float) for m in mags]), 0.05) ** 2).mean())
            yield pd.DataFrame({"call_id": pdf["call_id"], "speech": speech, "noise": noise})

    rows = spectra.groupBy("call_id").agg(F.collect_list("power").alias("powers"), F.collect_list("mags").alias("mags"))
    return rows.mapInPandas(levels, f"call_id {_type_of_call(spectra)}, speech double, noise double")


def _spectrum_by_scans(spectra: DataFrame) -> DataFrame:
    """(call_id, speech, noise) of calls of any length."""
    bins = spectra.select("call_id", F.posexplode("mags").alias("bin", "mag"))
    floors = quantiles(bins, ["call_id", "bin"], "mag", {"floor": 0.05})
    noise = floors.groupBy("call_id").agg(F.avg(F.col("floor") * F.col("floor")).alias("noise"))
    p60 = quantiles(spectra, CALL, "power", {"p60": 0.60}).drop("n_values")
    speech = (
        spectra.select("call_id", "power")
        .join(p60, "call_id")
        .where(F.col("power") >= F.col("p60"))
        .groupBy("call_id")
        .agg(F.avg("power").alias("speech"))
    )
    return speech.join(noise, "call_id")


def snr_by_spectrum(spectra: DataFrame, row_frames: int = ROW_FRAMES) -> DataFrame:
    """Speech over noise power from per-bin noise floors.

    ``spectra`` has (call_id, frame_idx, power, mags array). Noise is the mean square of each bin's
    5th percentile; speech is the mean power of frames from the 60th percentile. Calls of up to
    ``row_frames`` frames are summed up in a row, the bins of longer ones by scans.
    """
    spectra = shared(spectra)
    bins, x = F.size("mags"), F.col("power")
    # Only plain numbers and as many bins in every frame; what else there may be is left to the scans.
    plain = (bins > 0) & x.isNotNull() & ~F.isnan(x) & F.forall("mags", lambda m: m.isNotNull() & ~F.isnan(m))
    sizes = spectra.groupBy("call_id").agg(
        ((F.count(F.lit(1)) <= row_frames) & F.every(F.coalesce(plain, F.lit(False))) & (F.min(bins) == F.max(bins))).alias("__fits")
    )
    sized = spectra.select("call_id", "power", "mags").join(sizes, "call_id")
    levels = _spectrum_in_rows(sized.where("__fits").drop("__fits")).unionByName(_spectrum_by_scans(sized.where("not __fits").drop("__fits")))
    return levels.select(
        "call_id", decibels(F.col("speech"), F.col("noise")).alias("snr_db"), F.lit("spectrum").alias("path")
    )


def snr(frames: DataFrame, spectra: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SNR per call; calls without sustained silence use their spectra."""
    frames = shared(frames)
    silence = shared(sustained_silence(frames, block_rows=block_rows))
    gated = snr_by_silence(frames, silence)
    if spectra is None:
        return gated
    rest = silence.where("not has_silence").select("call_id")
    return gated.unionByName(snr_by_spectrum(spectra.join(rest, "call_id", "left_semi")))


def low_energy_snr(frames: DataFrame, share: float = 0.1) -> DataFrame:
    """Mean power over the mean of the lowest ``share`` of frame energies, in decibels.

    The k-th smallest energy is found exactly, then the k smallest are summed as all values below it
    plus as many copies of it as are missing; nothing is sorted per call.
    """
    n = F.col("n_values")
    k = F.greatest(F.lit(1), F.floor(F.lit(share) * n))
    kth = quantiles(frames, CALL, "energy", order_stats={"kth": (share, k - 1)})
    kth = kth.withColumn("k", k)
    below = F.col("energy") < F.col("kth")
    sums = (
        frames.join(kth, "call_id")
        .groupBy("call_id", "k", "kth")
        .agg(
            F.avg("energy").alias("power"),
            F.sum(F.when(below, F.col("energy")).otherwise(0.0)).alias("low"),
            F.count_if(below).alias("n_low"),
        )
    )
    noise = (F.col("low") + F.col("kth") * (F.col("k") - F.col("n_low"))) / F.col("k")
    return sums.withColumn("noise", noise).select(
        "call_id",
        "power",
        "noise",
        F.when(F.col("noise") <= 0, F.lit(float("inf")))
        .otherwise(10 * F.log10(F.col("power") / F.col("noise")))
        .alias("snr_db"),
    )


def clipping_ratio(
    samples: DataFrame, threshold: float = 0.99, min_run: int = 3, index: str = "frame_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Share of samples inside runs of at least ``min_run`` samples at or above the threshold."""
    runs = clipped_runs(samples, threshold, min_run, index, block_rows)
    clipped = runs.groupBy("call_id").agg(F.sum("run_len").alias("n_clipped"))
    sizes = samples.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return sizes.join(clipped, "call_id", "left").select(
        "call_id",
        "n_samples",
        steady(F.coalesce("n_clipped", F.lit(0)) / F.col("n_samples"), 6).alias("clipping_ratio"),
    )


def clipped_runs(
    samples: DataFrame, threshold: float = 0.99, min_run: int = 3, index: str = "frame_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    runs = quiet_runs(samples, CALL, index, block_rows, F.abs("level") >= threshold)
    return runs.where(F.col("run_len") >= min_run)


def quality_grade(before: DataFrame, after: DataFrame, hum: DataFrame | None = None) -> DataFrame:
    """Compare the metrics of a raw and a processed signal (call_id, snr_db)."""
    both = before.select("call_id", F.col("snr_db").alias("b")).join(
        after.select("call_id", F.col("snr_db").alias("a")), "call_id"
    )
    gain = F.col("a") - F.col("b")
    out = both.select(
        "call_id",
        steady(F.col("b"), 2).alias("snr_before_db"),
        steady(F.col("a"), 2).alias("snr_after_db"),
        steady(gain, 2).alias("snr_improvement_db"),
        F.when((F.col("a") >= 15.0) | ((gain >= 2.0) & (F.col("a") > 5.0)), "PASS").otherwise("FAIL").alias("audio_quality_grade"),
    )
    if hum is not None:
        out = out.join(hum.select("call_id", (F.col("drop_db") >= 15.0).alias("hum_removed")), "call_id", "left")
    return out


# --- band power --------------------------------------------------------------------------------
def partial_bins(x: np.ndarray, offset: int, n: int, first: int, count: int) -> np.ndarray:
    """Contribution of the samples at ``offset`` to Fourier bins first..first+count-1 of n samples.

    A chirp transform: cost grows with (samples + bins), not with their product.
    """
    m, j = np.arange(len(x), dtype=np.int64), np.arange(count, dtype=np.int64)
    turn = lambda steps, whole: np.exp(-2j * np.pi * ((steps % whole) / whole))
    a = x * turn(first * m, n) * turn(m * m, 2 * n)
    lags = np.arange(-(len(x) - 1), count, dtype=np.int64)
    chirp = np.conj(turn(lags * lags, 2 * n))
    size = 1 << (len(x) + len(chirp) - 1).bit_length()
    conv = np.fft.ifft(np.fft.fft(a, size) * np.fft.fft(chirp, size))[len(x) - 1 : len(x) - 1 + count]
    return conv * turn(j * j, 2 * n) * turn((first + j) * offset, n)


def band_power(
    blocks: DataFrame, sample_rate: float, block_samples: int, low_hz: float = 48.0, high_hz: float = 52.0
) -> DataFrame:
    """Energy of each call in a narrow band: (call_id, band_power).

    Every block adds its part to the few Fourier bins inside the band; the parts are summed per
    (call, bin) with partial sums per task. Without a bin in the band the nearest one is used.
    ``blocks`` has (call_id, block_idx, samples); all but a call's last hold ``block_samples``.
    """
    n = blocks.groupBy("call_id").agg(F.sum(F.size("samples")).alias("n"))
    hz = F.lit(float(sample_rate)) / F.col("n")
    first = F.ceil(F.lit(low_hz) / hz)
    last = F.least(F.floor(F.lit(high_hz) / hz), F.floor(F.col("n") / 2))
    near = F.least(
        F.floor(F.col("n") / 2), F.greatest(F.lit(0), F.ceil(F.lit((low_hz + high_hz) / 2) / hz - 0.5))
    )
    plan = n.select(
        "call_id",
        "n",
        F.when(last >= first, first).otherwise(near).cast("long").alias("first"),
        F.when(last >= first, last - first + 1).otherwise(1).cast("long").alias("count"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict = {}
            for call, block, x, size, k0, count in pdf.itertuples(index=False):
                part = partial_bins(np.asarray(x, float), int(block) * block_samples, int(size), int(k0), int(count))
                sums[call] = sums[call] + part if call in sums else part
            yield pd.DataFrame(
                {
                    "call_id": list(sums),
                    "re": [v.real for v in sums.values()],
                    "im": [v.imag for v in sums.values()],
                }
            )

    parts = (
        blocks.join(plan, "call_id")
        .select("call_id", "block_idx", "samples", "n", "first", "count")
        .mapInPandas(run, f"call_id {_type_of_call(blocks)}, re array<double>, im array<double>")
    )
    bins = parts.select("call_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    totals = bins.groupBy("call_id", "bin").agg(F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    return totals.groupBy("call_id").agg(
        F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("band_power")
    )


def band_drop(raw: DataFrame, processed: DataFrame, sample_rate: float, block_samples: int) -> DataFrame:
    """How many decibels the band lost; 100 if nothing is left of it."""
    before = band_power(raw, sample_rate, block_samples).withColumnRenamed("band_power", "p0")
    after = band_power(processed, sample_rate, block_samples).withColumnRenamed("band_power", "p1")
    drop = F.when(F.col("p1") == 0, 100.0).otherwise(10 * F.log10((F.col("p0") + 1e-10) / (F.col("p1") + 1e-10)))
    return before.join(after, "call_id").select("call_id", drop.alias("drop_db"))


# --- loudness ----------------------------------------------------------------------------------
def compressor_gain(
    samples: DataFrame,
    window: int,
    threshold_db: float = -20.0,
    ratio: float = 3.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Moving loudness and the gain a compressor would aim for.

    ``samples`` has (call_id, sample_idx, level). The window of ``window`` samples starts half a
    window before the sample; at both ends the nearest full window is used. Rows near a block edge
    are copied next door, so no window ever needs a whole call.
    """
    left = window // 2
    rows = with_halo(samples.select("call_id", "sample_idx", "level"), "sample_idx", block_rows, left, window - left - 1)
    frame = Window.partitionBy("call_id", BLOCK).orderBy("sample_idx").rowsBetween(-left, window - left - 1)
    rows = rows.withColumns(
        {"__n": F.count(F.lit(1)).over(frame), "__m": F.avg(F.col("level") * F.col("level")).over(frame)}
    ).where("__home")
    full = F.col("__n") == window
    rows = rows.withColumn("rms", F.when(full, F.sqrt(F.col("__m") + 1e-10)))
    ends = rows.where(full).groupBy("call_id").agg(
        F.min_by("rms", "sample_idx").alias("__head"), F.max_by("rms", "sample_idx").alias("__tail")
    )
    rows = rows.join(ends, "call_id", "left").withColumn(
        "rms", F.coalesce("rms", F.when(F.col("sample_idx") < left, F.col("__head")).otherwise(F.col("__tail")))
    )
    threshold = 10.0 ** (threshold_db / 20.0)
    gain = F.when(F.col("rms") > threshold, F.pow(threshold / F.col("rms"), F.lit(1.0 - 1.0 / ratio))).otherwise(1.0)
    return rows.select("call_id", "sample_idx", "level", "rms", gain.alias("gain"))


# --- prosody -----------------------------------------------------------------------------------
TURN = ["call_id", "seg_idx"]


def irregularity(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Jitter (voiced periods) and shimmer (loudness) per turn."""
    block = block_of(F.col("frame_idx"), block_rows)
    voiced = frames.where(F.col("pitch_hz") > 0).select(*TURN, "frame_idx", (1.0 / F.col("pitch_hz")).alias("period"))
    voiced = previous(voiced, TURN, ["frame_idx"], block, {"before": "period"})
    jit = voiced.groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("period") - F.col("before"))).alias("diff"),
        F.avg("period").alias("mean"),
    )
    jit = jit.select(
        *TURN, F.when((F.col("n") >= 2) & (F.col("mean") > 0), F.col("diff") / F.col("mean")).otherwise(0.0).alias("jitter")
    )
    loud = previous(frames.select(*TURN, "frame_idx", "rms"), TURN, ["frame_idx"], block, {"before": "rms"})
    shim = loud.groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("rms") - F.col("before"))).alias("diff"),
        F.avg("rms").alias("mean"),
    )
    shim = shim.select(
        *TURN,
        F.when((F.col("n") >= 2) & (F.col("mean") > 1e-10), F.col("diff") / F.col("mean")).otherwise(0.0).alias("shimmer"),
    )
    return shim.join(jit, TURN, "left").withColumn("jitter", F.coalesce("jitter", F.lit(0.0)))


def prosody(frames: DataFrame, peak: str = "rms", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Prosodic statistics per turn.

    ``frames`` has (call_id, seg_idx, frame_idx, pitch_hz, rms, zcr); ``peak`` is the column whose
    largest absolute value is the turn's peak level.
    """
    voiced = F.col("pitch_hz") > 0
    pitch = F.when(voiced, F.col("pitch_hz"))
    base = frames.groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(voiced).alias("voiced_count"),
        F.avg(pitch).alias("pitch_mean"),
        F.stddev_pop(pitch).alias("pitch_std"),
        F.min(pitch).alias("pitch_min"),
        F.max(pitch).alias("pitch_max"),
        F.avg("rms").alias("rms_mean"),
        F.stddev_pop("rms").alias("rms_std"),
        F.min("rms").alias("rms_min"),
        F.max("rms").alias("rms_max"),
        F.avg("zcr").alias("speaking_rate_zcr"),
        F.stddev_pop("zcr").alias("zcr_std"),
        F.max("zcr").alias("zcr_max"),
        F.min("frame_idx").alias("first_frame"),
        F.max(F.when(voiced, F.struct("pitch_hz", (-F.col("frame_idx")).alias("neg")))).alias("top"),
        F.max(F.abs(peak)).alias("peak_val"),
    )
    both = frames.select(*TURN, pitch.alias("pitch"), "rms")
    quartiles = column_quantiles(both, TURN, {"pitch": {"pitch_p25": 0.25, "pitch_p75": 0.75}, "rms": {"rms_p25": 0.25, "rms_p75": 0.75}})
    limit = F.greatest(F.lit(1e-4), 0.05 * F.col("rms_max"))
    pauses = (
        frames.select(*TURN, "rms")
        .join(base.select(*TURN, "rms_max"), TURN)
        .groupBy(*TURN)
        .agg(F.avg(F.when(F.col("rms") < limit, 1.0).otherwise(0.0)).alias("pause_ratio"))
    )
    out = (
        base.join(quartiles, TURN)
        .join(pauses, TURN)
        .join(irregularity(frames, block_rows), TURN)
    )
    peak_idx = F.when(F.col("voiced_count") > 0, -F.col("top.neg") - F.col("first_frame")).otherwise(0)
    out = out.withColumn("peak_f0_idx", peak_idx.cast("long"))
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            **{c: F.coalesce(c, zero) for c in ("pitch_mean", "pitch_std", "pitch_min", "pitch_max", "pitch_p25", "pitch_p75")},
            "voiced_ratio": F.col("voiced_count") / F.col("n_frames"),
            "compression_ratio": F.col("peak_val") / (F.col("rms_mean") + 1e-10),
            "hif0_relative_pos": F.col("peak_f0_idx") / F.col("n_frames"),
        }
    )
    return out.withColumn("hif0_section", peak_section(F.col("hif0_relative_pos"))).drop("top", "first_frame")


def prosody_vector(stats: DataFrame, seconds: str = "duration_s") -> DataFrame:
    """The 32 numbers of a turn as one vector; the last three places are reserved."""
    s = F.col("hif0_section")
    one = lambda name: F.when(s == name, 1.0).otherwise(0.0)
    parts: Sequence[Column] = [
        *[F.col(c) for c in ("pitch_mean", "pitch_std", "pitch_min", "pitch_max", "pitch_p25", "pitch_p75")],
        F.col("voiced_ratio"),
        *[F.col(c) for c in ("rms_mean", "rms_std", "rms_min", "rms_max", "rms_p25", "rms_p75")],
        *[F.col(c) for c in ("speaking_rate_zcr", "zcr_std", "zcr_max", "jitter", "shimmer", "pause_ratio")],
        *[F.col(c) for c in ("compression_ratio", "hif0_relative_pos")],
        one("beginning"),
        one("middle"),
        one("end"),
        *[F.col(c) for c in ("n_frames", seconds, "voiced_count", "peak_f0_idx", "peak_val")],
        *[F.lit(0.0)] * 3,
    ]
    return stats.withColumn("vector", F.array(*[p.cast("double") for p in parts]))


# --- frames from samples -----------------------------------------------------------------------
def pitches(frames: np.ndarray, sr: int, low: float = 50.0, high: float = 500.0, voicing: float = 0.3) -> np.ndarray:
    """Fundamental frequency of each row of ``frames``, 0 where it is unvoiced or silent.

    A frame's pitch is sr / lag for the lag of its greatest autocorrelation between the periods of ``high`` and ``low``; the
    frame is voiced if that is at least ``voicing`` of the energy. The products of all frames come from one transform, padded by the
    longest lag so that nothing wraps around.
    """
    width = frames.shape[1]
    lags = np.arange(int(sr // high), min(int(-(-sr // low)), width - 1) + 1)
    if len(frames) == 0 or len(lags) < 2 or lags[0] < 1:
        return np.zeros(len(frames))
    centred = frames - frames.mean(axis=1, keepdims=True)
    spectrum = np.fft.rfft(centred, width + lags[-1], axis=1)
    products = np.fft.irfft(spectrum * spectrum.conj(), width + lags[-1], axis=1)
    energy, candidates = products[:, 0], products[:, lags]
    loud = (energy > 1e-10) & (energy >= 1e-10 * width)
    voiced = loud & (candidates.max(axis=1) >= voicing * energy)
    return np.where(voiced, sr / lags[candidates.argmax(axis=1)], 0.0)


def _with_tail(blocks: DataFrame, halo: int) -> DataFrame:
    """Blocks followed by the first samples of the next block; only those few samples are moved."""
    heads = blocks.select(
        "call_id", (F.col("block_idx") - 1).alias("block_idx"), F.slice("samples", 1, halo).alias("__head")
    )
    return blocks.join(heads, ["call_id", "block_idx"], "left").withColumn(
        "__tail", F.coalesce("__head", F.array().cast("array<double>"))
    )


def _frames_fit(size: int, block_samples: int) -> None:
    """A frame reaches into the next block at most; a longer one would not be seen."""
    if block_samples < size:
        raise ValueError(f"blocks of {block_samples} samples cannot hold frames of {size}")


def _type_of_call(blocks: DataFrame) -> str:
    return blocks.schema["call_id"].dataType.simpleString()


def frame_features(
    blocks: DataFrame, sample_rate: int, block_samples: int, size_s: float = 0.03, stride_s: float = 0.01
) -> DataFrame:
    """Pitch, loudness and zero crossings per frame from sample blocks.

    ``blocks`` has (call_id, block_idx, samples array<double>); all but a call's last block hold
    ``block_samples`` samples. A frame belongs to the block in which it starts.
    """
    size, hop = int(round(size_s * sample_rate)), int(round(stride_s * sample_rate))
    _frames_fit(size, block_samples)
    schema = f"call_id {_type_of_call(blocks)}, frame_idx long, rms double, zcr double, pitch_hz double, peak double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for call, block, samples, tail in zip(pdf.call_id, pdf.block_idx, pdf.samples, pdf["__tail"], strict=True):
                x = np.concatenate([np.asarray(samples, float), np.asarray(tail, float)])
                if block == 0 and len(x) < size:
                    x = np.pad(x, (0, size - len(x)))
                first = int(block) * block_samples
                starts = np.arange((-first) % hop, len(samples), hop)
                starts = starts[starts + size <= len(x)]
                if len(starts) == 0:
                    continue
                f = np.lib.stride_tricks.sliding_window_view(x, size)[starts]
                yield pd.DataFrame(
                    {
                        "call_id": [call] * len(starts),
                        "frame_idx": (first + starts) // hop,
                        "rms": np.sqrt((f * f).mean(axis=1)),
                        "zcr": np.count_nonzero(np.diff(np.signbit(f), axis=1), axis=1) / size_s,
                        "pitch_hz": pitches(f, sample_rate),
                        "peak": np.abs(f).max(axis=1),
                    }
                )

    return _with_tail(blocks, size).select("call_id", "block_idx", "samples", "__tail").mapInPandas(run, schema)


def frame_spectra(
    blocks: DataFrame, sample_rate: int, block_samples: int, size_s: float = 0.02
) -> DataFrame:
    """Power and Hann-windowed magnitudes per half-overlapping frame."""
    size = int(size_s * sample_rate)
    hop = size // 2
    _frames_fit(size, block_samples)
    schema = f"call_id {_type_of_call(blocks)}, frame_idx long, power double, mags array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann = np.hanning(size)
        for pdf in batches:
            out = {"call_id": [], "frame_idx": [], "power": [], "mags": []}
            for call, block, samples, tail in zip(pdf.call_id, pdf.block_idx, pdf.samples, pdf["__tail"], strict=True):
                x = np.concatenate([np.asarray(samples, float), np.asarray(tail, float)])
                first = int(block) * block_samples
                starts = np.arange((-first) % hop, len(samples), hop)
                starts = starts[starts + size <= len(x)]
                if len(starts) == 0:
                    continue
                f = x[starts[:, None] + np.arange(size)]
                out["call_id"] += [call] * len(starts)
                out["frame_idx"] += list((first + starts) // hop)
                out["power"] += list((f * f).mean(axis=1))
                out["mags"] += list(np.abs(np.fft.rfft(f * hann, axis=1)))
            yield pd.DataFrame(out)

    return _with_tail(blocks, size).select("call_id", "block_idx", "samples", "__tail").mapInPandas(run, schema)
