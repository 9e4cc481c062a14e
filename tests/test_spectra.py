"""Spectra, interference, code search and correlators against plain loops over the whole recording."""

import numpy as np
import pytest

from orbitlake.operators import spectra

SIZE, HOP = 32, 12


def _chunks(spark, signals, cuts=(0, 5, 100, 101, 900)):
    rows = []
    for name, x in signals.items():
        edges = sorted({min(c, len(x)) for c in cuts} | {len(x)})
        rows += [(name, a, [float(v) for v in x[a:b]]) for a, b in zip(edges, edges[1:])]
    return spark.createDataFrame([*rows, ("empty", 0, [])], "rec string, start long, samples array<double>").repartition(3)


def _power(x):
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(SIZE) / (SIZE - 1)))
    k = np.exp(-2j * np.pi * np.outer(np.arange(SIZE), np.arange(SIZE // 2 + 1)) / SIZE)
    return {f: 10 * np.log10(np.abs((x[f * HOP : f * HOP + SIZE] * w) @ k) ** 2 + 1e-20) for f in range((len(x) - SIZE) // HOP + 1)}


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(1)
    t = np.arange(2500)
    return {"noise": r.normal(size=2500), "tone": r.normal(size=2500) + 30 * np.sin(2 * np.pi * 5 / SIZE * t), "short": r.normal(size=20), None: r.normal(size=300)}


def test_spectrogram_equals_direct_sums(spark, signals):
    got = {(r.rec, r.frame): r.power for r in spectra.spectrogram(_chunks(spark, signals), ["rec"], SIZE, HOP).collect()}
    want = {(n, f): p for n, x in signals.items() for f, p in _power(x).items()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-6)


def test_a_gap_leaves_its_frames_out(spark):
    x = np.arange(200.0)
    df = spark.createDataFrame([("a", 0, x[:80].tolist()), ("a", 90, x[90:].tolist())], "rec string, start long, samples array<double>")
    got = {r.frame for r in spectra.spectrogram(df, ["rec"], SIZE, HOP).collect()}
    assert got == {f for f in range((200 - SIZE) // HOP + 1) if f * HOP + SIZE <= 80 or f * HOP >= 90}


def _floor(means):
    out = []
    for b in range(len(means)):
        near = sorted(means[i] for i in range(max(0, b - 16), min(len(means), b + 17)) if abs(i - b) > 2)
        out.append(near[len(near) // 2])
    return np.array(out)


def test_floors_bands_and_excision(spark, signals):
    df = _chunks(spark, signals)
    spec = spectra.spectrogram(df, ["rec"], SIZE, HOP)
    floors = {(r.rec, r.bin): r.floor for r in spectra.noise_floors(spec, ["rec"]).collect()}
    for n in ("noise", "tone", None):
        want = _floor(np.mean(list(_power(signals[n]).values()), axis=0))
        np.testing.assert_allclose([floors[n, b] for b in range(SIZE // 2 + 1)], want, atol=1e-9)
    bands = spectra.interference(spec, ["rec"], SIZE, 1000.0, 15.0).collect()
    assert {r.rec for r in bands} == {"tone"} and any(r.low <= 5 < r.low + r.width for r in bands)
    out = {n: np.full(len(x), np.nan) for n, x in signals.items()}
    for r in spectra.excise(df, ["rec"], SIZE, HOP, 15.0).collect():
        out[r.rec][r.start : r.start + len(r.samples)] = r.samples
    w = np.hanning(SIZE)
    x, total, weight = signals["tone"], np.zeros(2500), np.zeros(2500)
    limit = np.array([floors["tone", b] for b in range(SIZE // 2 + 1)]) + 15.0
    for f, p in _power(x).items():
        at = slice(f * HOP, f * HOP + SIZE)
        spectrum = np.fft.rfft(x[at] * w)
        spectrum[p > limit] = 0
        total[at] += np.fft.irfft(spectrum, SIZE) * w
        weight[at] += w * w
    want = np.where(weight > 1e-8, total / np.maximum(weight, 1e-8), 0)
    np.testing.assert_allclose(out["tone"], want, atol=1e-9)
    assert np.var(out["tone"][50:-50]) < 0.1 * np.var(x)
    np.testing.assert_allclose(out["short"], signals["short"])


def test_kinds_of_bands(spark):
    n_bins, frames = 129, 40
    base = np.zeros((frames, n_bins))

    def table(paint):
        p = base.copy()
        paint(p)
        return [(f, [float(v) for v in p[f]]) for f in range(frames)]

    def chirp(p):
        for f in range(frames):
            p[f, 60 + f // 10 * 2 : 64 + f // 10 * 2] = 60

    def wide(p):
        p[5:17, 20:40] = 40

    kinds = {"cw": lambda p: p[:, 30:32].__setitem__(slice(None), 40), "chirp": chirp, "narrowband": lambda p: p[:, 30:36].__setitem__(slice(None), 40)}
    rows = [(k, *r) for k, paint in kinds.items() for r in table(paint)]
    df = spark.createDataFrame(rows, "rec string, frame long, power array<double>")
    got = {r.rec: r.kind for r in spectra.interference(df, ["rec"], 256, 1000.0, 15.0).collect()}
    assert got == {"cw": "cw", "chirp": "chirp", "narrowband": "narrowband"}


def test_codes():
    codes = [spectra.ranging_code(p) for p in range(1, 33)]
    assert [int(c) for c in codes[0][:10]] == [1, 1, -1, -1, 1, -1, -1, -1, -1, -1]
    assert all(len(c) == 1023 and abs(c.sum()) == 1 for c in codes)
    assert len({tuple(c) for c in codes}) == 32
    assert set(np.round(np.fft.ifft(np.fft.fft(codes[0]) * np.conj(np.fft.fft(codes[0]))).real).astype(int)[1:]) <= {-65, -1, 63}


def test_search_finds_planted_codes(spark):
    rate, n = 2.046e6, 2046
    t = np.arange(n) / rate
    r = np.random.default_rng(4)
    chips = spectra.ranging_code(7)
    delayed = np.roll(chips[(t * spectra.CHIP_RATE).astype(int) % 1023], 300)
    planted = delayed * np.cos(2 * np.pi * (4000.0 + 1500.0) * t) + 0.3 * r.normal(size=n)
    df = spark.createDataFrame([(None, [float(v) for v in planted]), ("noise", [float(v) for v in r.normal(size=n)]), ("zero", [0.0] * n)], "rec string, samples array<double>")
    got = {(x.rec, x.prn): x for x in spectra.acquire(df, ["rec"], rate, [7, 8, 40], 4000.0, 3000.0, 500.0, 2.5).collect()}
    hit = got[None, 7]
    assert hit.acquired and abs(hit.code_phase - 300) < 1 and hit.doppler_hz == 1500.0
    assert len(got) == 9 and sum(x.acquired for x in got.values()) == 1
    assert got["zero", 7].snr == 0.0 and got[None, 40].snr == 0.0


def test_correlators_over_many_rows(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=3000)
    df = _chunks(spark, {"a": x}, cuts=(0, 700, 701, 2000))
    channels = spark.createDataFrame([("a", 1, 3, 1000.25, 1.023e6, 0.1, 1200.0, True), ("a", 2, 5, 0.0, 1.023e6, 0.0, 0.0, False), ("b", 3, 5, 0.0, 1.023e6, 0.0, 0.0, True)],
                                     "rec string, channel int, prn int, code_phase double, code_freq double, carrier_phase double, carrier_freq double, locked boolean")
    got = {row.channel: tuple(row)[2:] for row in spectra.correlate(df, channels, ["rec"], "channel", 4e6, 0.5).collect()}
    chips, want = spectra.ranging_code(3), [0.0] * 6
    for i, v in enumerate(x):
        phase = 2 * np.pi * (0.1 + 1200.0 * i / 4e6)
        for j, d in enumerate((0.25, 0.0, -0.25)):
            c = chips[int((1000.25 + 1.023e6 * i / 4e6 + d) % 1023)]
            want[2 * j] += v * np.cos(phase) * c
            want[2 * j + 1] += v * np.sin(phase) * c
    np.testing.assert_allclose(got[1], want, atol=1e-8)
    assert got[2] == (0.0,) * 6 and got[3] == (0.0,) * 6
