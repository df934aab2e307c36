"""Filtering by regions and by what is shown, and spectra at markers, against plain loops and known tones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.operators import shaping as H
from sonoframe.operators import spectral as P


def plain(x, size, rate, regions, shown):
    """One step after another over whole channels (channels, frames)."""
    hop, window, n = size // 4, [math.sin(math.pi * i / size) for i in range(size)], x.shape[1]
    norm, hz = (2 / sum(window)) ** 2, [k * rate / size for k in range(size // 2 + 1)]
    keep = lambda f, lo, hi: 0.5 + 0.5 * math.cos(math.pi * min(1, max(0, max(lo - f, f - hi) / (2 * rate / size))))
    out = np.zeros((len(x), n + 2 * size))
    for start in range(-size + hop - size % hop, n, hop):
        around = [r for r in regions if r[0] <= start + size // 2 < r[1]]
        if regions and not around:
            continue
        spectra = []
        for channel in x:
            spectra.append(np.fft.rfft([(channel[start + i] if 0 <= start + i < n else 0) * w for i, w in enumerate(window)]))
        for c, s in enumerate(spectra):
            gains = []
            for k, f in enumerate(hz):
                g = max((keep(f, *r[2:]) for r in around), default=1)
                if shown:
                    p = abs(s[k] if shown.apart else sum(y[k] for y in spectra) / len(spectra)) ** 2 * norm
                    level = 10 * math.log10(p) if p else -math.inf
                    t = min(1, max(0, (level - shown.floor) / 6)) if shown.soft else float(level > shown.floor)
                    gains.append((g * keep(f, *shown.band), t * t * (3 - 2 * t)))
                else:
                    gains.append((g, 1))
            gate = [t for _, t in gains]
            if shown and shown.soft:
                gate = [0.25 * gate[max(k - 1, 0)] + 0.5 * gate[k] + 0.25 * gate[min(k + 1, len(gate) - 1)] for k in range(len(gate))]
            y = np.fft.irfft(s * np.array([g for g, _ in gains]) * gate, n=size)
            out[c, start + size : start + 2 * size] += y * window / 2
    return out[:, size : size + n]


CASES = [(None, []), (None, [(300, 700, 500.0, 1500.0), (600, 650, 2000.0, 2500.0)]), (H.Shown(-40.0, (200.0, 3000.0), True), []), (H.Shown(-35.0, (200.0, 3000.0), False, True), [(-100, 5000, 0.0, 1e6)])]


@pytest.mark.parametrize(("shown", "regions"), CASES)
@pytest.mark.parametrize("frames", [40, 300, 5000])
def test_stretches_equal_one_pass(spark, shown, regions, frames):
    x = np.random.default_rng(3).normal(size=(2, 1003)) * np.linspace(0.01, 1, 1003)
    rows = [(1, c, first, x[c, first : first + 170].tolist()) for c in (0, 1) for first in range(0, 1003, 170)]
    blocks = spark.createDataFrame(rows, "rec_id long, channel int, first_frame long, samples array<double>")
    lengths = spark.createDataFrame([(1, 1003, 2), (2, 50, 1)], "rec_id long, frames long, channels long")
    marks = spark.createDataFrame([(1, *r) for r in regions], "rec_id long, lo long, hi long, lo_hz double, hi_hz double")
    out = np.zeros((2, 1003))
    empty = np.zeros(50)
    for r in H.shaped(blocks, marks, lengths, 8000.0, 64, shown, frames).collect():
        (out[r["channel"]] if r["rec_id"] == 1 else empty)[r["first_frame"] : r["first_frame"] + len(r["samples"])] += r["samples"]
    assert np.allclose(out, plain(x, 64, 8000.0, regions, shown), atol=1e-9) and not empty.any()


def test_all_kept_gives_back_what_went_in():
    x = np.random.default_rng(1).normal(size=(1, 1000))
    assert np.allclose(H.stretch(x, 0, 0, 1000, 128, 8000.0, [], False, None), x)
    assert not H.stretch(x, 0, 0, 1000, 128, 8000.0, [], True, None).any()


def tone(hz, n, rate=48_000):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_a_region_keeps_its_band_and_a_band_what_is_shown():
    x = (0.4 * tone(1000, 48_000) + 0.4 * tone(9000, 48_000))[None]
    loud = lambda y, hz: P.around(y, 24_000, 2048)[round(hz * 2048 / 48_000)]
    y = H.stretch(x, 0, 0, 48_000, 2048, 48_000.0, [(12_000, 36_000, 500.0, 2000.0)], True, None)[0]
    assert loud(y, 1000) > -10 and loud(y, 9000) < -80 and np.abs(y[:9000]).max() < 1e-9
    y = H.stretch(x, 0, 0, 48_000, 2048, 48_000.0, [], False, H.Shown(-200.0, (5000.0, 20_000.0)))[0]
    assert loud(y, 1000) < -80 and loud(y, 9000) > -10
    quiet = (0.4 * tone(1000, 48_000) + 0.001 * tone(9000, 48_000))[None]
    y = H.stretch(quiet, 0, 0, 48_000, 2048, 48_000.0, [], False, H.Shown(-30.0, (0.0, 24_000.0)))[0]
    assert loud(y, 1000) > -10 and loud(y, 9000) < -90


def test_spectra_at_markers(spark):
    """Left a loud tone of 3 kHz, right silence; markers inside, before and past the ends."""
    n = 48_000
    left = tone(3000, n)
    rows = [(1, c, first, (left if c == 0 else np.zeros(n))[first : first + 5000].tolist()) for c in (0, 1) for first in range(0, n, 5000)]
    blocks = spark.createDataFrame(rows, "rec_id long, channel int, first_frame long, samples array<double>")
    lengths = spark.createDataFrame([(1, n, 2), (3, 0, 1)], "rec_id long, frames long, channels long")
    marks = [(1, "a", 1000), (1, "b", 24_000), (1, "b", 24_000), (1, "end", 10**6), (2, "lost", 5), (3, "none", 0), (1, "null", None)]
    markers = spark.createDataFrame(marks, "rec_id long, marker string, frame long")
    found = P.spectra_at(blocks, markers, lengths, 2048).collect()
    assert sorted((r["marker"], r["target"]) for r in found) == [("a", 0), ("a", 1), ("b", 0), ("b", 0), ("b", 1), ("b", 1), ("end", 0), ("end", 1)]
    for r in found:
        assert np.argmax(r["levels"]) == 128 if r["target"] == 0 else max(r["levels"]) == -200
        if r["marker"] == "b":
            assert np.allclose(r["levels"], P.around(left if r["target"] == 0 else np.zeros(n), 24_000, 2048), atol=1e-6)
    mixed = {r["marker"]: r for r in P.spectra_at(blocks, markers, lengths, 2048, "mix").collect()}
    assert mixed["b"]["target"] is None and abs(max(mixed["b"]["levels"]) + 6.02) < 0.1
    one = P.spectra_at(blocks, markers, lengths, 2048, 1)
    assert {r["target"] for r in one.collect()} == {1} and P.spectra_at(blocks, markers, lengths, 2048, 7).where(F.col("target").isNull()).count() == 4


def test_spectra_at_markers_do_not_depend_on_buckets(spark):
    """Centres before, at and past both ends and around buckets' borders, in blocks with gaps, many markers on one centre."""
    n, rng = 400, np.random.default_rng(8)
    x = rng.normal(size=(2, n))
    x[:, 200:300] = 0  # no block holds these
    rows = [(1, c, first, x[c, first : first + 30].tolist()) for c in (0, 1) for first in (*range(0, 200, 30), *range(300, n, 30))]
    rows = [(r, c, first, s[: 200 - first] if first < 200 else s) for r, c, first, s in rows]
    blocks = spark.createDataFrame(rows, "rec_id long, channel int, first_frame long, samples array<double>")
    lengths = spark.createDataFrame([(1, n, 2)], "rec_id long, frames long, channels long")
    at = {i: f for i, f in enumerate([-60, -5, 0, 3, 31, 32, 33, 63, 64, 150, 199, 219, 225, 250, 281, 299, 380, 399, 400, 999, 150, 150])}
    markers = spark.createDataFrame([(1, i, f) for i, f in at.items()], "rec_id long, marker int, frame long")
    extent, expected = P.reach(16), {}
    for i, f in at.items():
        low, high = max(min(f, n) - extent, 0), min(f + extent, n)
        if high > low and not 200 <= low < high <= 300:  # else no block reaches it
            expected |= {(i, c): P.around(x[c, low:high], min(f, n) - low, 16) for c in (0, 1)}
    for width in (32, 100, 4096):
        frame = P.spectra_at(blocks, markers, lengths, 16, width=width)
        assert "FlatMapGroups" not in frame._jdf.queryExecution().toString()  # no call a marker
        found = {(r["marker"], r["target"]): r["levels"] for r in frame.collect()}
        assert found.keys() == expected.keys() and all(np.allclose(found[k], expected[k]) for k in expected)


def test_spectrogram_does_not_depend_on_groups(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=5000)
    blocks = spark.createDataFrame([(1, first, x[first : first + 300].tolist()) for first in range(0, 5000, 300)], "rec_id long, first_frame long, samples array<double>")
    lengths = spark.createDataFrame([(1, 5000)], "rec_id long, frames long")
    found = []
    for group, held in ((64, 1 << 22), (3, 1 << 22), (64, 2000), (64, 1)):
        monkeypatch.setattr(P, "HELD", held)
        rows = sorted(P.spectrogram(blocks, lengths, 20, 64, group=group).collect(), key=lambda r: r["column"])
        assert [r["column"] for r in rows] == list(range(20))
        found.append(np.array([r["levels"] for r in rows]))
    assert all(np.allclose(f, found[0]) for f in found)
