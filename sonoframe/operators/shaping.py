"""Filtering by time and frequency: regions' bands and what a spectrogram shows, by overlap-add over a fixed grid.

Steps of a short-time transform stand on a grid fixed to frame 0, a quarter of a window apart, with root-Hann windows
in and out. A step keeps each bin as the regions around its middle, the shown band and the level over the floor say.
Recordings come in blocks; a task makes a stretch of output, for which it reads the blocks under all steps that reach
into it (a halo of one window), so stretches are exact, are never joined again, and no recording has to fit in a task.

Defined results: without regions every bin is kept; where a recording has regions but none is around a step, the step is silent;
frames that no block holds are silent; blocks past a recording's length are cut; null keys and recordings without a
length give no rows; one channel is shaped by its own level, two by their mean's unless `apart`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decibels over the floor over which a soft edge fades in.
SOFT = 6.0


@dataclass(frozen=True)
class Shown:
    """What is let through: bins over a floor (dB) within a band (Hz); softly over 6 dB; each channel by itself if apart."""

    floor: float
    band: tuple[float, float]
    soft: bool = False
    apart: bool = False


def kept(hz: np.ndarray, low: float, high: float, bin_hz: float) -> np.ndarray:
    """How much of each bin a band keeps: all inside, a raised cosine over two bins outside."""
    past = np.clip(np.maximum(low - hz, hz - high) / (2 * bin_hz), 0, 1)
    return 0.5 + 0.5 * np.cos(np.pi * past)


def smooth(gains: np.ndarray) -> np.ndarray:
    """Each bin's gain with its neighbours', by a quarter, a half and a quarter; the ends stand for what they lack."""
    padded = np.pad(gains, ((0, 0), (1, 1)), mode="edge")
    return 0.25 * padded[:, :-2] + 0.5 * gains + 0.25 * padded[:, 2:]


def over_floor(power: np.ndarray, floor: float, soft: bool) -> np.ndarray:
    """Of squared magnitudes: 0 at or under the floor, 1 over it, softly over SOFT dB and smoothed over bins."""
    if not soft:
        return (power > floor).astype(float)
    with np.errstate(divide="ignore"):
        t = np.clip(10 * np.log10(power / floor) / SOFT, 0, 1)
    return smooth(t * t * (3 - 2 * t))


def region_gains(middles: np.ndarray, regions: list[tuple[int, int, float, float]], any_: bool, bins: int, bin_hz: float) -> np.ndarray:
    """(steps, bins): how much the regions (lo, hi, lo_hz, hi_hz) around each middle keep."""
    if not any_:
        return np.ones((len(middles), bins))
    out = np.zeros((len(middles), bins))
    hz = np.arange(bins) * bin_hz
    for lo, hi, lo_hz, hi_hz in regions:
        a, b = np.searchsorted(middles, [lo, hi])
        if b > a:
            np.maximum(out[a:b], kept(hz, lo_hz, hi_hz, bin_hz), out=out[a:b])
    return out


def stretch(signal: np.ndarray, first: int, start: int, end: int, size: int, rate: float, regions: list, any_: bool, shown: Shown | None) -> np.ndarray:
    """Frames start to end of `signal` (channels, frames from `first` on) shaped; what isn't there is silence."""
    hop, bins, bin_hz = size // 4, size // 2 + 1, rate / size
    steps = np.arange((start - size) // hop + 1, (end - 1) // hop + 1)
    low, high = int(steps[0]) * hop, int(steps[-1]) * hop + size
    source = np.zeros((len(signal), high - low))
    a, b = max(first, low), min(first + signal.shape[1], high)
    if b > a:
        source[:, a - low : b - low] = signal[:, a - first : b - first]
    window = np.sin(np.pi * np.arange(size) / size)
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(source, size, axis=1)[:, ::hop] * window)
    gains = region_gains(steps * hop + size // 2, regions, any_, bins, bin_hz)[None]
    if shown is not None:
        floor = 10 ** (shown.floor / 10) / (2 / window.sum()) ** 2
        heard = spectra if shown.apart else spectra.mean(0, keepdims=True)
        gains = gains * kept(np.arange(bins) * bin_hz, *shown.band, bin_hz) * np.stack([over_floor(np.abs(x) ** 2, floor, shown.soft) for x in heard])
    shaped = np.fft.irfft(spectra * gains, n=size) * window / 2  # windows overlap to twice what went in
    out = np.zeros_like(source)
    for i in range(len(steps)):
        out[:, i * hop : i * hop + size] += shaped[:, i]
    return out[:, start - low : end - low]


def shaped(recordings: DataFrame, regions: DataFrame, lengths: DataFrame, rate: float, size: int, shown: Shown | None = None, frames: int = 1 << 16) -> DataFrame:
    """Of blocks (rec_id, channel, first_frame, samples), regions (rec_id, lo, hi, lo_hz, hi_hz) and lengths (rec_id,
    frames, channels): blocks of about `frames` frames, shaped."""
    hop = size // 4
    width = max(1, frames // hop) * hop
    anyone = regions.groupBy("rec_id").agg(F.lit(True).alias("any"))
    known = lengths.where("frames > 0").join(anyone, "rec_id", "left").select("rec_id", "frames", "channels", F.coalesce("any", F.lit(False)).alias("any"))
    last = F.floor((F.col("frames") - 1) / width)
    parts = lambda low, high: F.explode(F.sequence(F.greatest(F.floor(low / width), F.lit(0)), F.least(F.floor(high / width), last)))
    end = F.col("first_frame") + F.size("samples")
    # a stretch reads the frames of its steps: one window less one hop on either side
    heard = recordings.where("size(samples) > 0 and first_frame >= 0").join(known, "rec_id").where("first_frame < frames and channel < channels")
    heard = heard.withColumn("part", parts(F.col("first_frame") - size, end - 1 + size))
    heard = heard.select("rec_id", "part", "frames", "channels", "any", F.col("channel").cast("long").alias("kind"), F.col("first_frame").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("lo_hz"), F.lit(0.0).alias("hi_hz"), "samples")
    around = regions.where("lo < hi").join(known, "rec_id").where(f"lo < frames + {size} and hi > -{size}")
    around = around.withColumn("part", parts(F.col("lo") - size, F.col("hi") + size))
    around = around.select("rec_id", "part", "frames", "channels", "any", F.lit(-1).cast("long").alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("lo_hz").cast("double").alias("lo_hz"), F.col("hi_hz").cast("double").alias("hi_hz"), F.lit(None).cast("array<double>").alias("samples"))
    # each part has a row of its own, so that one without blocks is silence rather than missing
    every = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("rec_id", "part", "frames", "channels", "any", F.lit(-2).cast("long").alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("lo_hz"), F.lit(0.0).alias("hi_hz"), F.lit(None).cast("array<double>").alias("samples"))
    rows = every.unionByName(around).unionByName(heard).repartition("rec_id", "part").sortWithinPartitions("rec_id", "part", "kind", "a")
    kind = dict(rows.dtypes)["rec_id"]

    def made(key: tuple, n: int, channels: int, any_: bool, held: list, own: list) -> pd.DataFrame:
        start = int(key[1]) * width
        stop = min(start + width, n)
        low, high = start - size, stop + size
        signal = np.zeros((channels, high - low))
        for channel, first, samples in held:
            a, b = max(first, low), min(first + len(samples), high, n)
            if b > a:
                signal[channel, a - low : b - low] = samples[a - first : b - first]
        out = stretch(signal, low, start, stop, size, rate, own, any_, shown)
        return pd.DataFrame({"rec_id": key[0], "channel": np.arange(channels, dtype=np.int32), "first_frame": start, "samples": list(out)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts stream by, their rows together: only one part's rows are held."""
        key, head, held, own = None, (), [], []
        ends = pd.DataFrame([{"rec_id": None, "part": -1, "frames": 0, "channels": 0, "any": False, "kind": -2, "a": 0, "b": 0, "lo_hz": 0.0, "hi_hz": 0.0, "samples": None}])
        for pdf in itertools.chain(batches, [ends]):
            for rec, part, n, channels, any_, what, a, b, lo_hz, hi_hz, samples in pdf.itertuples(index=False, name=None):
                if what == -2:
                    if key is not None:
                        yield made(key, *head, held, own)
                    key, head, held, own = (rec, part), (int(n), int(channels), bool(any_)), [], []
                elif what == -1:
                    own.append((int(a), int(b), lo_hz, hi_hz))
                else:
                    held.append((int(what), int(a), samples))

    return rows.mapInPandas(work, f"rec_id {kind}, channel int, first_frame long, samples array<double>")
