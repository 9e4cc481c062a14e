"""Recordings of samples, as rows (recording, start, samples) of any length: spectra, interference, code search and correlators.

A recording is cut into blocks of frames; each block gets the pieces of the rows that it overlaps, so that no task holds a
recording. Where rows overlap, the later start counts; a sample that is missing, null or NaN makes its frames missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of stages of the second register whose sum gives the code of satellites 1 to 32.
STAGES = [
    (2, 6), (3, 7), (4, 8), (5, 9), (1, 9), (2, 10), (1, 8), (2, 9), (3, 10), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10),
    (1, 4), (2, 5), (3, 6), (4, 7), (5, 8), (6, 9), (1, 3), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10), (1, 6), (2, 7), (3, 8), (4, 9),
]
CHIPS, CHIP_RATE = 1023, 1.023e6
#: Neighbours of a bin to both sides that make its floor, and those next to it that do not.
NEAR, GUARD = 16, 2
#: Fixed value: samples around the first correlation peak that are no second peak.
PEAK_GUARD = 16
FRAMES_A_BLOCK = 64


def _schema(df: DataFrame, by: list[str], more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields], more])


def _as_keys(df: DataFrame, by: list[str], right: DataFrame) -> tuple[DataFrame, Column]:
    """`right` with its `by` columns as r0, r1, ... and the null-safe condition that they equal those of df."""
    renamed = right.withColumnsRenamed({c: f"__r{i}" for i, c in enumerate(by)})
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & df[c].eqNullSafe(renamed[f"__r{i}"])
    return renamed, on


def _dealt(chunks: DataFrame, by: list[str], step: int, before: int, span: int) -> DataFrame:
    """(by, block, at, piece): the samples of block b, [b * step - before, b * step - before + span), by their place in it."""
    s, e = F.col("start"), F.col("start") + F.size("samples")
    first = F.greatest(F.lit(0), F.floor((s + before - span) / step) + 1)
    blocks = F.sequence(first.cast("long"), F.floor((e - 1 + before) / step).cast("long"))
    rows = chunks.where(F.size("samples") > 0).select(*by, "start", "samples", F.explode(blocks).alias("block"))
    origin = F.col("block") * step - before
    lo, hi = F.greatest(s, origin), F.least(e, origin + span)
    return rows.where(hi > lo).select(*by, "block", (lo - origin).alias("at"), F.slice("samples", (lo - s + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


def _joined(pieces: pd.DataFrame, span: int) -> np.ndarray:
    x = np.full(span, np.nan)
    for at, piece in sorted(zip(pieces["at"], pieces["piece"]), key=lambda p: p[0]):
        x[at : at + len(piece)] = np.asarray(piece, float)
    return x


def _power(spectrum: np.ndarray) -> np.ndarray:
    return 10 * np.log10(spectrum.real**2 + spectrum.imag**2 + 1e-20)


def spectrogram(chunks: DataFrame, by: list[str], size: int, hop: int) -> DataFrame:
    """(by, frame, power): dB of the bins 0 to size / 2 of each frame under a Hann window; frame f starts at sample f * hop."""
    step, span, window = FRAMES_A_BLOCK * hop, (FRAMES_A_BLOCK - 1) * hop + size, np.hanning(size)

    def frames(pieces: pd.DataFrame) -> pd.DataFrame:
        x = np.lib.stride_tricks.sliding_window_view(_joined(pieces, span), size)[::hop]
        whole = np.flatnonzero(~np.isnan(x).any(axis=1))
        out = pd.DataFrame({c: pd.Series([pieces[c].iloc[0]] * len(whole), dtype=object) for c in by})
        out["frame"] = pieces["block"].iloc[0] * FRAMES_A_BLOCK + whole
        out["power"] = pd.Series(list(_power(np.fft.rfft(x[whole] * window, axis=1))), dtype=object)
        return out

    return _dealt(chunks, by, step, 0, span).groupBy(*by, "block").applyInPandas(frames, _schema(chunks, by, "frame long, power array<double>"))


def noise_floors(spectra: DataFrame, by: list[str]) -> DataFrame:
    """(by, bin, mean, floor, frames): mean power of each bin, and the upper median of those of its neighbours but the nearest."""
    bins = spectra.select(*by, "frame", F.posexplode("power").alias("bin", "p")).groupBy(*by, "bin").agg(F.avg("p").alias("mean"), (F.max("frame") + 1).alias("frames"))
    w = Window.partitionBy(*by).orderBy("bin")
    side = lambda a, b: F.collect_list("mean").over(w.rowsBetween(a, b))
    near = F.array_sort(F.concat(side(-NEAR, -GUARD - 1), side(GUARD + 1, NEAR)))
    return bins.withColumn("__near", near).select(*by, "bin", "mean", F.coalesce(F.get("__near", F.floor(F.size("__near") / 2).cast("int")), F.col("mean")).alias("floor"), "frames")


def interference(spectra: DataFrame, by: list[str], size: int, rate: float, threshold: float = 15.0) -> DataFrame:
    """Runs of bins over their floor by `threshold` dB in a quarter of the frames: place, width, power, frames and kind.

    cw: at most two bins; up to size / 8 bins chirp, if the strongest bin of the first and the last quarter of the frames are
    two or more apart, else narrowband; wider ones pulsed, if they last less than half the frames, else narrowband.
    """
    floors = noise_floors(spectra, by)
    long = spectra.select(*by, "frame", F.posexplode("power").alias("bin", "p"))
    floors, same = _as_keys(long, [*by, "bin"], floors)
    long = long.join(floors, same)
    hit, quarter = F.col("p") - F.col("floor") > threshold, F.floor(F.col("frames") / 4)
    bins = long.groupBy(*by, "bin").agg(
        F.count(F.when(hit, 1)).alias("hits"), F.max("p").alias("top"), F.first("floor").alias("floor"), F.first("frames").alias("frames"),
        F.min(F.when(hit, F.col("frame"))).alias("first"), F.max(F.when(hit, F.col("frame"))).alias("last"),
        F.coalesce(F.sum(F.when(F.col("frame") < quarter, F.col("p"))), F.lit(0.0)).alias("early"),
        F.coalesce(F.sum(F.when(F.col("frame") >= F.col("frames") - quarter, F.col("p"))), F.lit(0.0)).alias("late"))
    w = Window.partitionBy(*by).orderBy("bin")
    strong = bins.where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("frames") / 4))).withColumn("__run", F.col("bin") - F.row_number().over(w))
    peak = lambda c: F.min(F.struct((-F.col(c)).alias("p"), "bin", "floor"))
    runs = strong.groupBy(*by, "__run").agg(
        F.min("bin").alias("low"), F.count("*").alias("width"), peak("top").alias("t"), F.min("first").alias("first_frame"), F.max("last").alias("last_frame"),
        F.first("frames").alias("frames"), peak("early").alias("e"), peak("late").alias("l"))
    moved = (F.col("frames") >= 4) & (F.abs(F.col("e.bin") - F.col("l.bin")) >= 2)
    brief = (F.col("last_frame") - F.col("first_frame") + 1) / F.col("frames") < 0.5
    kind = F.when(F.col("width") <= 2, "cw").when(F.col("width") <= size // 8, F.when(moved, "chirp").otherwise("narrowband")).when(brief, "pulsed").otherwise("narrowband")
    bin_hz = rate / size
    return runs.select(*by, "low", "width", ((F.col("low") + F.col("width") / 2) * bin_hz).alias("centre_hz"), (F.col("width") * bin_hz).alias("bandwidth_hz"), (-F.col("t.p") - F.col("t.floor")).alias("power_db"), "first_frame", "last_frame", kind.alias("kind"))


def excise(chunks: DataFrame, by: list[str], size: int, hop: int, threshold: float = 15.0) -> DataFrame:
    """(by, start, samples): the recording with bins over their floor set to zero in each frame, frames added under the window.

    Samples that no frame covers with weight are 0; a recording without a whole frame comes back as it is.
    """
    step, before = FRAMES_A_BLOCK * hop, (size - 1) // hop * hop
    span, window = before + step - hop + size, np.hanning(size)
    dealt = _dealt(chunks, by, step, before, span)
    level = noise_floors(spectrogram(chunks, by, size, hop), by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "floor"))).alias("f"))
    blocks = dealt.select(*by, "block").distinct()
    level, same = _as_keys(blocks, by, level)
    # copies of the columns, as both sides of the groups below come from the same rows
    wanted = blocks.join(level, same).select(*[F.col(f"__r{i}") for i in range(len(by))], (F.col("block") + 0).alias("__b"), F.transform("f", lambda x: x.floor).alias("floors"))

    def clean(pieces: pd.DataFrame, floors: pd.DataFrame) -> pd.DataFrame:
        if not len(pieces):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*by, "start", "samples"]})
        x, block = _joined(pieces, span), int(pieces["block"].iloc[0])
        out = x.copy()
        if len(floors):
            out, weight = np.zeros(span), np.zeros(span)
            limit = np.asarray(floors["floors"].iloc[0]) + threshold
            first = -(-max(0, before - block * step) // hop) * hop  # frames start at sample 0
            for at in range(first, span - size + 1, hop):
                if not np.isnan(frame := x[at : at + size]).any():
                    spectrum = np.fft.rfft(frame * window)
                    spectrum[_power(spectrum) > limit] = 0
                    out[at : at + size] += np.fft.irfft(spectrum, size) * window
                    weight[at : at + size] += window * window
            out = np.divide(out, weight, out=np.zeros(span), where=weight > 1e-8)
        own = np.flatnonzero(~np.isnan(x[before : before + step]))
        runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1) if len(own) else []
        columns = {**{c: [pieces[c].iloc[0]] * len(runs) for c in by}, "start": [block * step + int(r[0]) for r in runs], "samples": [out[before + r] for r in runs]}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    left, right = dealt.groupBy(*by, "block"), wanted.groupBy(*[f"__r{i}" for i in range(len(by))], "__b")
    return left.cogroup(right).applyInPandas(clean, _schema(chunks, by, "start long, samples array<double>"))


def ranging_code(prn: int) -> np.ndarray:
    """The 1023 chips, -1 and 1, of a satellite: the first register's last stage plus two stages of the second one.

    Stage k of a register is its output 10 - k steps ahead, so that one sequence for each register is enough.
    """
    def sequence(stages: list[int]) -> np.ndarray:
        out = [1] * 10
        while len(out) < CHIPS + 10:
            out.append(sum(out[len(out) - k] for k in stages) % 2)
        return np.array(out)

    one, two = sequence([3, 10]), sequence([2, 3, 6, 8, 9, 10])
    a, b = STAGES[prn - 1]
    return 2 * (one[:CHIPS] ^ two[10 - a : 10 - a + CHIPS] ^ two[10 - b : 10 - b + CHIPS]) - 1


def acquire(signals: DataFrame, by: list[str], rate: float, prns: list[int], intermediate: float = 0.0, doppler_range: float = 5000.0, doppler_step: float = 500.0, threshold: float = 2.0) -> DataFrame:
    """(by, prn, acquired, code_phase, doppler_hz, snr) of each signal, a row with the samples of one search.

    All code phases are tried at once by transforms, Dopplers are dealt over tasks. snr is the peak over the highest value more
    than 16 samples from it, 0 where there is none; the phase is that of a parabola through the peak. Of equal ones the lowest
    Doppler counts; at intermediate 0 its sign cannot be told and is dropped. Numbers but 1 to 32 are never acquired.
    """
    steps = int(2 * doppler_range / doppler_step) + 1
    codes = {p: ranging_code(p) for p in prns if 1 <= p <= len(STAGES)}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                x = np.asarray(row.samples, float)
                n, keys = len(x), [getattr(row, f"k{i}") for i in range(len(by))]
                if n == 0 or np.isnan(x).any():
                    continue
                t = np.arange(n) / rate
                doppler = -doppler_range + row.step * doppler_step
                spectrum = np.fft.fft(x * np.exp(-2j * np.pi * (intermediate + doppler) * t))
                for prn, chips in codes.items():
                    mag = np.abs(np.fft.ifft(spectrum * np.conj(np.fft.fft(chips[(t * CHIP_RATE).astype(int) % CHIPS])))) ** 2
                    peak = int(mag.argmax())
                    apart = np.abs(np.arange(n) - peak)
                    apart = np.where(apart > n // 2, n - apart, apart)
                    second = mag[apart > PEAK_GUARD].max(initial=0.0)
                    low, top, high = mag[peak - 1], mag[peak], mag[(peak + 1) % n]
                    bend = low - 2 * top + high
                    shift = float(np.clip(0.5 * (low - high) / bend, -0.5, 0.5)) if n >= 3 and abs(bend) > 1e-12 else 0.0
                    found.append((*keys, prn, float(doppler), float(top / second) if second > 0 else 0.0, (peak + shift) % n))
            yield pd.DataFrame(found, columns=[*[f"k{i}" for i in range(len(by))], "prn", "doppler", "snr", "code_phase"])

    keyed = signals.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "samples")
    keys = [f"k{i}" for i in range(len(by))]
    dealt = keyed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).repartition(*keys, "step")
    tried = dealt.mapInPandas(search, _schema(keyed, keys, "prn int, doppler double, snr double, code_phase double"))
    best = tried.where("snr > 0").groupBy(*keys, "prn").agg(F.min(F.struct((-F.col("snr")).alias("lost"), "doppler", "code_phase")).alias("b"))
    all_prns = keyed.select(*keys, F.explode(F.array(*[F.lit(p) for p in prns])).alias("prn")).distinct()
    on = all_prns["prn"] == best["prn"]
    for k in keys:
        on = on & all_prns[k].eqNullSafe(best[k])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    doppler = F.abs(F.col("b.doppler")) if abs(intermediate) < 1e-12 else F.col("b.doppler")
    return all_prns.join(best, on, "left").select(
        *[all_prns[k].alias(c) for k, c in zip(keys, by)], all_prns["prn"], (zero(-F.col("b.lost")) > threshold).alias("acquired"),
        zero(F.col("b.code_phase")).alias("code_phase"), zero(doppler).alias("doppler_hz"), zero(-F.col("b.lost")).alias("snr"))


def correlate(chunks: DataFrame, channels: DataFrame, by: list[str], channel: str, rate: float, spacing: float = 0.5) -> DataFrame:
    """(by, channel, ei, eq, pi, pq, li, lq): early, prompt and late sums of each channel over its whole recording.

    A channel has prn, code_phase (chips), code_freq, carrier_phase (cycles), carrier_freq and locked; one that is not locked,
    or whose recording has no samples, sums to 0. Each row of samples is summed where it is, as its start gives the phases.
    """
    names = ["ei", "eq", "pi", "pq", "li", "lq"]
    state = ["prn", "code_phase", "code_freq", "carrier_phase", "carrier_freq"]
    own, same = _as_keys(chunks, by, channels.where("locked").select(*by, F.col(channel).alias("__ch"), *state))
    small = chunks.join(own, same).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "__ch", "start", "samples", *state).withColumnRenamed("__ch", "ch")
    keys = [*[f"k{i}" for i in range(len(by))], "ch"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                chips = codes.setdefault(r.prn, ranging_code(r.prn))
                x = np.nan_to_num(np.asarray(r.samples, float))
                t = (r.start + np.arange(len(x))) / rate
                mixed = x * np.exp(2j * np.pi * (r.carrier_phase + r.carrier_freq * t))
                place = r.code_phase + r.code_freq * t
                parts = [(mixed * chips[np.floor(place + d).astype(np.int64) % CHIPS]).sum() for d in (spacing / 2, 0.0, -spacing / 2)]
                out.append((*[getattr(r, k) for k in keys], *[v for p in parts for v in (p.real, p.imag)]))
            yield pd.DataFrame(out, columns=[*keys, *names])

    part = small.mapInPandas(sums, _schema(small, keys, ", ".join(f"{n} double" for n in names)))
    total = part.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]).select(*[F.col(k).alias(c) for k, c in zip(keys, [*by, channel])], *names)
    all_channels = channels.select(*by, channel)
    total, same = _as_keys(all_channels, [*by, channel], total)
    return all_channels.join(total, same, "left").select(*by, channel, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
