"""Changing a recording's rate in stretches: a windowed sinc between any two rates, a low-pass that thins out, and dither.

Each stretch of output is a task's work of its own: it gets the blocks under its filter (a halo on both sides), so
recordings of any length spread over the cluster and results don't depend on how blocks or stretches are cut. Dither
comes from one generator that runs through a whole recording: its state at any sample is found by a jump, a product
of powers of the generator's 64 x 64 bit matrix, so blocks are dithered in any order and equal the sequential result.

Defined results: frames that no block holds, before the start and past the end, are silent; a recording without frames
gives no rows; null keys give no rows; blocks of channels or frames that `lengths` doesn't count are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "channel int, first_frame long, samples array<double>"


def stretched(recordings: DataFrame, lengths: DataFrame, num: int, den: int, before: int, after: int, total: Callable, make: Callable, width: int) -> DataFrame:
    """Blocks (rec_id, channel, first_frame, samples) made anew, in stretches of `width` output frames.

    num / den: output frames of an input frame. Output frame m reads input frames from m * den // num - before to
    m * den // num + after. total: output frames of so many input frames, as a column. make(signal, first, start, end):
    output frames start to end of a signal (channels, frames from `first` on).
    """
    known = lengths.where("frames > 0 and rec_id is not null").select("rec_id", "frames", "channels", total(F.col("frames")).cast("long").alias("made")).where("made > 0")
    last = F.expr(f"(made - 1) div {width}L")
    part = lambda x: F.expr(f"(greatest({x}, 0) * {num}L) div ({den}L * {width}L)")
    heard = recordings.where("size(samples) > 0 and first_frame >= 0").join(known, "rec_id").where("first_frame < frames and channel >= 0 and channel < channels")
    heard = heard.withColumn("part", F.explode(F.sequence(F.least(part(f"first_frame - {after}"), last), F.least(part(f"first_frame + size(samples) + {before + 1}"), last))))
    heard = heard.select("rec_id", "part", "frames", "channels", "made", F.col("channel").cast("int").alias("channel"), "first_frame", "samples")
    every = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    every = every.select("rec_id", "part", "frames", "channels", "made", F.lit(-1).alias("channel"), F.lit(0).cast("long").alias("first_frame"), F.lit(None).cast("array<double>").alias("samples"))
    rows = every.unionByName(heard).repartition("rec_id", "part").sortWithinPartitions("rec_id", "part", "channel", "first_frame")

    def stretch(key: tuple, frames: int, channels: int, made: int, held: list) -> pd.DataFrame:
        start, end = key[1] * width, min((key[1] + 1) * width, made)
        low, high = start * den // num - before, (end - 1) * den // num + after + 1
        signal = np.zeros((channels, high - low))
        for channel, first, samples in held:
            a, b = max(first, low), min(first + len(samples), high, frames)
            if b > a:
                signal[channel, a - low : b - low] = samples[a - first : b - first]
        return pd.DataFrame({"rec_id": key[0], "channel": np.arange(channels, dtype=np.int32), "first_frame": start, "samples": list(make(signal, low, start, end))})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches stream by, their rows together: only one stretch's blocks are held."""
        key, head, held = None, (), []
        ends = pd.DataFrame([{"rec_id": None, "part": -1, "frames": 0, "channels": 0, "made": 0, "channel": -1, "first_frame": 0, "samples": None}])
        for pdf in itertools.chain(batches, [ends]):
            for rec, at, frames, channels, made, channel, first, samples in pdf.itertuples(index=False, name=None):
                if channel < 0:
                    if key is not None:
                        yield stretch(key, *head, held)
                    key, head, held = (rec, int(at)), (int(frames), int(channels), int(made)), []
                else:
                    held.append((int(channel), int(first), samples))

    return rows.mapInPandas(work, f"rec_id {dict(rows.dtypes)['rec_id']}, {BLOCKS}")


def taps(factor: int, beta: float = 8.6) -> np.ndarray:
    """A Kaiser-windowed low-pass of 16 taps a kept frame and one, summing to one."""
    n = 16 * factor + 1
    at = np.arange(n) - (n - 1) / 2
    h = np.sinc(at / factor) * np.kaiser(n, beta)
    return h / h.sum()


def decimated(recordings: DataFrame, lengths: DataFrame, factor: int, width: int = 1 << 14) -> DataFrame:
    """Low-passed, one frame for every `factor`: frame m weighs the frames up to (m + 1) * factor - 1, before the start silence."""
    h = taps(factor)

    def make(signal: np.ndarray, first: int, start: int, end: int) -> np.ndarray:
        out = np.empty((len(signal), end - start))
        windows = np.lib.stride_tricks.sliding_window_view(signal, len(h), axis=1)
        at = (np.arange(start, end) + 1) * factor - len(h) - first
        for a in range(0, len(at), 1024):
            out[:, a : a + 1024] = windows[:, at[a : a + 1024]] @ h[::-1]
        return out

    return stretched(recordings, lengths, 1, factor, len(h), factor, lambda n: F.ceil(n / factor), make, width)


# fixed values: the Blackman-Harris window
HARRIS = (0.35875, 0.48829, 0.14128, 0.01168)
#: Zero crossings of the sinc on either side, and where it cuts off, as a part of the lower of two Nyquist frequencies.
CROSSINGS, CUTOFF = 16, 0.95


@cache
def bank(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from m * den // num, and the filter of each phase (num, offsets), each summing to one."""
    c = CUTOFF * min(1, num / den)
    half = CROSSINGS / c
    offsets = np.arange(-math.ceil(half), math.ceil(half) + 2)
    t = np.arange(num)[:, None] / num - offsets
    u = np.clip(t / half, -1, 1)
    window = sum(a * np.cos(k * np.pi * u) for k, a in enumerate(HARRIS))
    h = np.where(np.abs(t) < half, np.sinc(c * t) * window, 0)
    return offsets, h / h.sum(1, keepdims=True)


def resampled(recordings: DataFrame, lengths: DataFrame, rate: int, to: int, width: int = 1 << 15) -> DataFrame:
    """From one rate to another: floor(frames * to / rate) frames, in step with the original's, none lost at either end."""
    num, den = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    offsets, filters = bank(num, den)

    def make(signal: np.ndarray, first: int, start: int, end: int) -> np.ndarray:
        out = np.empty((len(signal), end - start))
        for a in range(start, end, 2048):
            m = np.arange(a, min(a + 2048, end))
            at, phase = m * den // num, m * den % num
            out[:, a - start : a - start + len(m)] = np.einsum("cmt,mt->cm", signal[:, at[:, None] + offsets - first], filters[phase])
        return out

    return stretched(recordings, lengths, num, den, -int(offsets[0]), int(offsets[-1]), lambda n: F.expr(f"(frames * {num}L) div {den}L"), make, width)


# fixed values: the generator's seed and factor (xorshift64*)
SEED, STAR = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
#: Draws that run side by side.
LANES = 256


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ (s >> np.uint64(12))
    s = s ^ (s << np.uint64(25))
    return s ^ (s >> np.uint64(27))


@cache
def _matrix(power: int) -> np.ndarray:
    """The columns of the step's bit matrix to the power 2^power."""
    if power == 0:
        return _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    half = _matrix(power - 1)
    return _times(half, half)


def _times(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for bit in range(64):
        out ^= np.where((states >> np.uint64(bit)) & np.uint64(1) == 1, matrix[bit], np.uint64(0))
    return out


def jumped(steps: np.ndarray) -> np.ndarray:
    """The generator's state after so many steps from the seed."""
    states = np.full(len(steps), SEED, dtype=np.uint64)
    for power in range(int(steps.max(initial=0)).bit_length()):
        on = (steps >> power) & 1 == 1
        states[on] = _times(_matrix(power), states[on])
    return states


#: Samples of blocks whose noise is drawn together.
TOGETHER = 1 << 20


def noises(firsts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Triangular noise of samples first to first + size of many blocks: each sample's is the difference of two draws.

    Blocks are cut into lanes of one length that are jumped to at once and drawn side by side.
    """
    firsts, sizes = np.asarray(firsts, dtype=np.int64), np.asarray(sizes, dtype=np.int64)
    each = max(1, min(int(sizes.max(initial=0)), -(-int(sizes.sum()) // LANES), max(1, TOGETHER // max(1, len(sizes)))))
    many = -(-sizes // each)
    ends = np.cumsum(many)
    within = np.arange(int(many.sum()), dtype=np.int64) - np.repeat(ends - many, many)
    states = jumped(2 * (np.repeat(firsts, many) + each * within))
    draws = np.empty((len(states), 2 * each))
    for i in range(2 * each):
        states = _step(states)
        draws[:, i] = ((states * np.uint64(STAR)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    made = draws[:, ::2] - draws[:, 1::2]
    return [made[end - n : end].ravel()[:size] for end, n, size in zip(ends, many, sizes)]


def noise(first: int, n: int) -> np.ndarray:
    """The same of one block."""
    return noises(np.array([first]), np.array([n]))[0]


def rounded(x: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers of a depth: halves away from zero, within range."""
    full = 2.0 ** (bits - 1)
    return np.clip(np.trunc(x + np.copysign(0.5, x)), -full, full - 1).astype(np.int64)


def dithered(recordings: DataFrame, lengths: DataFrame, bits: int) -> DataFrame:
    """Blocks (rec_id, channel, first_frame, samples) at full scale 1 as whole numbers of a depth, dithered; no shuffle of
    samples but the join with lengths (rec_id, channels; gain if there), which the samples are weighed by first.

    The generator draws for every channel of a frame in turn, so a block's noise is that of its own samples alone.
    """
    gain = F.col("gain") if "gain" in lengths.columns else F.lit(1.0)
    rows = recordings.where("samples is not null").join(lengths.select("rec_id", "channels", gain.cast("double").alias("gain")), "rec_id")
    rows = rows.select("rec_id", "channel", "first_frame", "samples", "channels", "gain")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            of = [(int(first * channels), len(samples) * int(channels)) for first, samples, channels in zip(pdf["first_frame"], pdf["samples"], pdf["channels"])]
            run = np.cumsum([n for _, n in of]) // TOGETHER
            for _, part in pdf.groupby(run):
                spans = [of[i] for i in pdf.index.get_indexer(part.index)]
                known = list(dict.fromkeys(spans))  # blocks that begin alike share their noise
                drawn = dict(zip(known, noises(*np.array(known, dtype=np.int64).T)))
                for span, channel, samples, channels, gain in zip(spans, part["channel"], part["samples"], part["channels"], part["gain"]):
                    out.append(rounded(np.asarray(samples) * gain * 2.0 ** (bits - 1) + drawn[span][channel::channels], bits))
            yield pdf[["rec_id", "channel", "first_frame"]].assign(samples=out)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(work, f"rec_id {kinds['rec_id']}, channel {kinds['channel']}, first_frame long, samples array<long>")


def narrowed(samples: np.ndarray, first: int, bits: int, to: int) -> np.ndarray:
    """Whole samples of a depth at a smaller one: noise of one new step before rounding."""
    step = 2.0 ** (bits - to)
    return rounded((samples + noise(first, len(samples)) * step) / step, to)


def converted(recordings: DataFrame, lengths: DataFrame, rate: int, to: int, bits: int) -> DataFrame:
    """Resampled, turned down where a recording would peak over full scale, and dithered to a depth."""
    moved = resampled(recordings, lengths, rate, to)
    peak = F.max(F.greatest(F.coalesce(F.abs(F.array_max("samples")), F.lit(0.0)), F.coalesce(F.abs(F.array_min("samples")), F.lit(0.0))))
    gains = moved.groupBy("rec_id").agg(peak.alias("peak")).join(lengths.select("rec_id", "channels"), "rec_id")
    return dithered(moved, gains.select("rec_id", "channels", F.when(F.col("peak") > 1, 1 / F.col("peak")).otherwise(1.0).alias("gain")), bits)
