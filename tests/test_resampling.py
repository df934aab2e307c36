"""Rates and depths changed in stretches, and a coder's partitions and predictors, against plain sequential versions."""

import math

import numpy as np
import pytest

from sonoframe.operators import coding as K
from sonoframe.operators import resampling as R
from sonoframe.operators import spectral as P

M64 = (1 << 64) - 1


def draws(n):
    s, out = R.SEED, []
    for _ in range(n):
        s ^= s >> 12
        s ^= (s << 25) & M64
        s ^= s >> 27
        out.append(((s * R.STAR & M64) >> 11) / 2**53)
    return out


def test_a_jump_gives_the_sequential_noise():
    u = draws(8000)
    want = [u[2 * i] - u[2 * i + 1] for i in range(4000)]
    for first, n in ((0, 4000), (1, 1), (1234, 700), (3999, 1), (0, 256), (100, 257)):
        assert R.noise(first, n).tolist() == want[first : first + n]
    far = R.noise(10**12, 10)
    assert far.tolist() == R.noise(10**12 - 5, 15)[5:].tolist() and abs(far).max() < 1


def test_dither_of_whole_numbers_is_within_a_step_and_unbiased():
    x = np.arange(-20_000, 20_000)
    y = R.narrowed(x, 0, 24, 16)
    assert np.abs(y * 256 - x).max() <= 1.5 * 256 and abs((y * 256 - x).mean()) < 3
    assert R.narrowed(np.array([2**23 - 1, -(2**23)]), 0, 24, 16).tolist() == [32767, -32768]


def blocks(spark, x, size, rec=1):
    rows = [(rec, c, first, x[c, first : first + size].tolist()) for c in range(len(x)) for first in range(0, x.shape[1], size)]
    return spark.createDataFrame(rows, "rec_id long, channel int, first_frame long, samples array<double>")


def joined(rows, rec=1):
    out = {}
    for r in sorted(rows, key=lambda r: r["first_frame"]):
        if r["rec_id"] == rec:
            out.setdefault(r["channel"], []).extend(r["samples"])
    return np.array([out[c] for c in sorted(out)])


@pytest.mark.parametrize(("rate", "to"), [(44100, 48000), (48000, 44100), (96000, 8000), (8000, 8001), (48000, 48000)])
def test_resampling_does_not_depend_on_blocks(spark, rate, to):
    x = np.random.default_rng(2).normal(size=(2, 3001))
    lengths = spark.createDataFrame([(1, 3001, 2), (2, 0, 1), (3, 10, 1)], "rec_id long, frames long, channels long")
    a = R.resampled(blocks(spark, x, 170), lengths, rate, to, width=200).collect()
    b = R.resampled(blocks(spark, x, 3001), lengths, rate, to, width=10**6).collect()
    assert joined(a).shape == (2, 3001 * to // rate) and np.allclose(joined(a), joined(b), atol=1e-12)
    assert not joined(a, 3).any() and len(joined(a, 3)[0]) == 10 * to // rate if 10 * to // rate else True
    assert {r["rec_id"] for r in a} <= {1, 3}


def test_a_tone_keeps_its_pitch_level_and_place(spark):
    n = 44100
    x = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(n) / 44100)[None]
    lengths = spark.createDataFrame([(1, n, 1)], "rec_id long, frames long, channels long")
    y = joined(R.resampled(blocks(spark, x, 5000), lengths, 44100, 48000).collect())[0]
    want = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(48000) / 48000)
    assert np.abs(y - want)[200:-200].max() < 1e-3
    high = np.sin(2 * np.pi * 21000 * np.arange(n) / 44100)[None]
    low = joined(R.resampled(blocks(spark, high, 5000), lengths, 44100, 22050).collect())[0]
    assert np.abs(low[200:-200]).max() < 1e-3  # above what the lower rate holds


@pytest.mark.parametrize("factor", [1, 2, 7])
def test_decimation_equals_one_pass(spark, factor):
    x = np.random.default_rng(4).normal(size=(1, 500))
    lengths = spark.createDataFrame([(1, 500, 1)], "rec_id long, frames long, channels long")
    y = joined(R.decimated(blocks(spark, x, 33), lengths, factor, width=20).collect())[0]
    whole = np.concatenate([np.convolve(x[0], R.taps(factor)), np.zeros(factor)])
    assert np.allclose(y, whole[factor - 1 :: factor][: math.ceil(500 / factor)], atol=1e-12)


def test_noise_of_many_blocks_is_that_of_each():
    """Whatever blocks are drawn together: short and long ones, empty ones, far ones."""
    whole = np.concatenate([R.noise(i, 1) for i in range(40)])
    firsts, sizes = [0, 5, 39, 7, 0, 10**9, 3], [40, 3, 1, 0, 5000, 70, 37]
    found = R.noises(np.array(firsts), np.array(sizes))
    assert [len(x) for x in found] == sizes
    assert all(np.array_equal(x, R.noise(f, n)) for x, f, n in zip(found, firsts, sizes))
    assert np.array_equal(found[0], whole) and np.array_equal(found[1], whole[5:8]) and np.array_equal(found[4][:40], whole)


def test_a_conversion_is_turned_down_and_dithered(spark):
    x = 1.5 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)[None]
    lengths = spark.createDataFrame([(1, 4000, 1)], "rec_id long, frames long, channels long")
    y = joined(R.converted(blocks(spark, x, 900), lengths, 8000, 16000, 16).collect())[0]
    assert len(y) == 8000 and 32760 <= y.max() <= 32767 and P.around(y[2000:6000] / 32768, 2000, 1024).argmax() == round(440 * 1024 / 16000)


def rice(u, n, warmup):
    """Straight from the definition: every order, partition by partition."""
    best = None
    for order in range(9):
        if order and (n % (1 << order) or n >> order <= warmup):
            break
        size, total, params, raw, wide, at = n >> order, 0, [], 0, False, 0
        for p in range(1 << order):
            part = u[at : at + size - (warmup if p == 0 else 0)]
            at += len(part)
            mean = sum(part) // len(part) if part else 0
            guess = mean.bit_length() - 1 if mean else 0
            cost, k = min((len(part) * (k + 1) + sum(v >> k for v in part), k) for k in {max(guess - 1, 0), guess, guess + 1} if k <= 30)
            widest = max((1 + (v >> 1).bit_length() for v in part), default=0)
            if part and len(part) * widest + 5 < cost:
                params.append(None)
                raw, total = max(raw, widest), total + 5 + len(part) * widest
            else:
                params.append(k)
                wide, total = wide or k > 14, total + cost
        total += (1 << order) * (5 if wide else 4) + 6
        if best is None or total < best[1]:
            best = (order, total, params, raw, wide)
    return best


def test_rice_partitions(spark):
    rng = np.random.default_rng(7)
    made = {
        0: (256, 2, np.concatenate([rng.integers(-3, 3, 126), rng.integers(-4000, 4000, 128)])), 1: (256, 0, np.zeros(256, int)), 2: (255, 4, rng.integers(-50, 50, 251)),
        3: (1024, 8, (rng.normal(size=1016) * np.exp(rng.normal(size=1016) * 3)).astype(int)), 4: (512, 1, rng.integers(-(2**31), 2**31, 511)), 5: (64, 32, rng.integers(-9, 9, 32)), 6: (3, 0, np.array([-1, 0, 1])),
    }
    for b, (n, warmup, r) in made.items():
        rows = spark.createDataFrame([(b, warmup + i, int(v)) for i, v in enumerate(r)] + [(b, None, 5), (None if b else b, 1, None)], "b long, at long, value long")
        found = K.rice_partitions(rows, ["b"], warmup).where(f"b = {b}").first()
        want = rice([int(-2 * v - 1 if v < 0 else 2 * v) for v in r], n, warmup)
        assert (found["order"], found["bits"], found["parameters"], found["raw"], found["wide"]) == want, b


def test_predictors(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(4000)
    x[:2] = 1, 0.5
    for i in range(2, 4000):
        x[i] = 1.2 * x[i - 1] - 0.5 * x[i - 2] + 0.1 * rng.normal()
    s = np.round(x * 1000)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(s)] + [(2, i, 0.0) for i in range(50)] + [(3, 0, 7.0)], "b long, at long, value double")
    found = {(r["b"], r["order"]): r for r in K.predictors(rows, ["b"], 8, 16).collect()}
    assert {b for b, _ in found} == {1}  # silence and a lone tapered sample have none
    taper = 1000
    window = np.ones(4000)
    window[:taper] = 0.5 - 0.5 * np.cos(np.pi * np.arange(taper) / taper)
    window[-taper:] = window[:taper][::-1]
    w = s * window
    auto = np.array([w[: 4000 - k] @ w[k:] for k in range(9)])
    for order in range(1, 9):
        solved = np.linalg.solve(auto[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))], auto[1 : order + 1])
        r = found[1, order]
        assert np.allclose(np.array(r["coefficients"]) / 2.0 ** r["shift"], solved, atol=2.0 ** -r["shift"])
        assert abs(r["error"] / (auto[0] - solved @ auto[1 : order + 1]) - 1) < 1e-6
    assert np.allclose(np.array(found[1, 2]["coefficients"]) / 2.0 ** found[1, 2]["shift"], [1.2, -0.5], atol=0.05)
    assert [K.precision(b, n) for b, n in ((8, 100), (12, 1), (16, 192), (16, 193), (16, 4609), (24, 384), (24, 385), (24, 1153))] == [6, 8, 7, 8, 13, 13, 14, 15]
