"""Short-time spectra: windows around the centres of a recording's columns, their power, and masks over time and frequency.

A column's windows reach into its neighbours' frames. Recordings come in blocks, and a block is sent to every column
group that its frames reach (its own, and a halo), so no recording has to fit in one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = -200.0


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power(frames: np.ndarray) -> np.ndarray:
    """The power of each row's bins: a full-scale tone in one bin reads 1; the first and last bins read 6 dB high."""
    window = hann(frames.shape[-1])
    return np.abs(np.fft.rfft(frames * window)) ** 2 * (2 / window.sum()) ** 2


def db(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(10 * np.log10(p), FLOOR)


def layout(frames: int, columns: int, fft: int, bins_held: int = 1 << 26, targets: int = 1) -> tuple[int, float, int]:
    """Columns, the frames of each, and the windows in each; a picture never holds more than bins_held levels."""
    columns = max(1, min(columns, bins_held // ((fft // 2 + 1) * targets), max(frames, 1)))
    span = frames / columns
    return columns, span, max(1, math.ceil(2 * span / fft))


def blocks(signal: DataFrame, size: int) -> DataFrame:
    """Long rows (rec_id, frame, x) as blocks (rec_id, first_frame, samples); missing frames of a block are zero."""
    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for first, frames, xs in zip(pdf["first_frame"], pdf["frames"], pdf["xs"]):
                made.append(np.zeros(size))
                made[-1][np.asarray(frames) - first] = xs
            yield pd.DataFrame({"rec_id": pdf.rec_id, "first_frame": pdf.first_frame, "samples": made})

    at = F.floor(F.col("frame") / size)
    known = signal.where("rec_id is not null and frame is not null and x is not null")
    rows = known.groupBy("rec_id", at.alias("block")).agg(F.collect_list(F.struct("frame", "x")).alias("s"))  # size rows at most
    rows = rows.select("rec_id", (F.col("block") * size).alias("first_frame"), F.col("s.frame").alias("frames"), F.col("s.x").alias("xs"))
    return rows.mapInPandas(dense, f"rec_id {dict(signal.dtypes)['rec_id']}, first_frame long, samples array<double>")


#: Frames that the columns of one task span, about, and samples of windows that are transformed at once.
HELD, AT_ONCE = 1 << 22, 1 << 22


def spectrogram(recordings: DataFrame, lengths: DataFrame, columns: int, fft: int, group: int = 64) -> DataFrame:
    """Of blocks (rec_id, first_frame, samples) and lengths (rec_id, frames): rec_id, column, levels (dB by bin).

    A column's level is the greatest of its windows'. `group` columns at most, fewer where they are long, make one
    task's work, with a halo of half a window on both sides; a group gets only blocks that it reads.

    Defined results: null keys and recordings without a length give no rows; missing frames are silent, and so is a column
    of a recording that no block reaches, which has no row.
    """
    size = F.size("samples")
    rows = recordings.join(lengths, "rec_id")
    n = F.greatest(F.lit(1), F.least(F.lit(columns), F.greatest(F.col("frames"), F.lit(1))))
    span = F.col("frames") / n
    many = F.greatest(F.lit(1), F.least(F.lit(group), F.floor(HELD / F.greatest(span, F.lit(1.0)))))
    low = F.floor((F.col("first_frame") - fft // 2) / span / many)
    high = F.floor((F.col("first_frame") + size + fft // 2) / span / many)
    last = F.floor((n - 1) / many)
    rows = rows.withColumn("part", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(high, last), F.lit(0)))))

    def levels(part: int, frames: int, held: list) -> tuple[np.ndarray, list]:
        """A group's columns, and their levels from its blocks (first_frame, samples)."""
        count, per, windows = layout(frames, columns, fft)
        many = max(1, min(group, math.floor(HELD / max(per, 1.0))))
        own = np.arange(part * many, min((part + 1) * many, count))
        if not len(own):
            return own, []
        centres = ((own[:, None] + (np.arange(windows)[None, :] + 0.5) / windows) * per).astype(np.int64)
        start, stop = int(centres.min()) - fft // 2, int(centres.max()) + fft // 2
        signal = np.zeros(stop - start)
        for first, samples in held:
            a, b = max(first, start, 0), min(first + len(samples), stop, frames)
            if b > a:
                signal[a - start : b - start] = samples[a - first : b - first]
        out = []
        for column in centres - fft // 2 - start:  # one at a time: its windows overlap, and would take twice its frames
            most = np.zeros(fft // 2 + 1)
            for first in range(0, windows, max(1, AT_ONCE // fft)):
                at = column[first : first + max(1, AT_ONCE // fft), None] + np.arange(fft)
                np.maximum(most, power(signal[at]).max(0), out=most)
            out.append(db(most))
        return own, out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups stream by, their rows together: only one group's blocks are held."""
        key, frames, held = None, 0, []
        last = pd.DataFrame({"rec_id": [-1], "part": [-1], "frames": [0], "first_frame": [0], "samples": [()]})  # ends the last group
        for pdf in itertools.chain(batches, [last]):
            out: dict[str, list] = {"rec_id": [], "column": [], "levels": []}
            for rec, part, n, first, samples in zip(pdf.rec_id, pdf.part, pdf.frames, pdf.first_frame, pdf.samples):
                if (rec, part) != key:
                    if held:
                        own, made = levels(int(key[1]), frames, held)
                        out["rec_id"] += [key[0]] * len(own)
                        out["column"] += own.tolist()
                        out["levels"] += made
                    key, frames, held = (rec, part), int(n), []
                held.append((first, samples))
            if out["rec_id"]:  # a batch may end within a group
                yield pd.DataFrame(out)

    rows = rows.where("rec_id is not null").select("rec_id", "part", "frames", "first_frame", "samples")
    rows = rows.repartition("rec_id", "part").sortWithinPartitions("rec_id", "part", "first_frame")
    return rows.mapInPandas(work, "rec_id long, column long, levels array<double>")


#: Windows that a spectrum around a frame averages, half a window apart.
AROUND = 8


def reach(fft: int) -> int:
    """Frames on either side of a marker that its spectrum may read."""
    return fft // 2 * (AROUND - 1) // 2 + fft // 2 + 1


def around(signal: np.ndarray, centre: int, fft: int) -> np.ndarray:
    """The mean power, in dB by bin, of AROUND windows half a window apart around signal[centre]; outside is silence."""
    hop = fft // 2
    first = max(centre - hop * (AROUND - 1) // 2, 0)
    padded = np.zeros(max(len(signal) + fft, first + hop * AROUND + 2 * fft))
    padded[hop : hop + len(signal)] = signal
    return db(power(padded[first + np.arange(AROUND)[:, None] * hop + np.arange(fft)]).mean(0))


def around_each(signals: np.ndarray, low: int, centres: np.ndarray, frames: int, fft: int) -> np.ndarray:
    """The same for many centres of signals (a row a target) that begin at frame low: by target, centre and bin. What is out
    of a centre's reach or past the frames is silence."""
    hop, extent = fft // 2, reach(fft)
    first = np.maximum(centres - hop * (AROUND - 1) // 2, 0)
    at = first[:, None, None] + (np.arange(AROUND)[:, None] - 1) * hop + np.arange(fft)
    ends = np.maximum(centres - extent, 0)[:, None, None], np.minimum(centres + extent, frames)[:, None, None]
    read = signals[:, np.clip(at - low, 0, signals.shape[1] - 1)] * ((at >= ends[0]) & (at < ends[1]))
    return db(power(read).mean(-2))


def spectra_at(recordings: DataFrame, markers: DataFrame, lengths: DataFrame, fft: int, channels: str | int = "all", width: int = 1 << 12) -> DataFrame:
    """Of blocks (rec_id, channel, first_frame, samples), markers (rec_id, marker, frame) and lengths (rec_id, frames,
    channels): rec_id, marker, target and levels (dB by bin) around every marker.

    channels: "all" for a spectrum of each channel, "mix" for their mean (target null), or one channel's number; "all" of a
    mono recording and a channel that it lacks are the mix. A frame past the end counts as the end. Blocks and
    centres meet in buckets of `width` frames with a halo on both sides; a bucket gets only the samples that its centres may
    read, once, and each distinct centre is worked out once, however many markers stand there. They join their levels after.

    Defined results: a marker without a recording, a recording without frames, and null keys give no rows; frames that
    no block holds are silent; markers of equal id and frame are each a row.
    """
    extent = reach(fft)
    known = lengths.where("frames > 0").select("rec_id", "frames", F.col("channels").alias("n"))
    marks = markers.where("frame is not null").join(known, "rec_id").withColumn("centre", F.least("frame", "frames").cast("long"))
    centres = marks.select("rec_id", F.floor(F.greatest("centre", F.lit(0)) / width).alias("bucket"), "centre", "frames", "n").distinct()
    end = F.col("first_frame") + F.size("samples")
    reached = F.sequence(F.greatest(F.floor((F.col("first_frame") - extent) / width), F.lit(0)), F.floor((end - 1 + extent) / width))
    blocks = recordings.where("size(samples) > 0").where(end > 0).withColumn("bucket", F.explode(reached))
    blocks = blocks.join(centres.select("rec_id", "bucket").distinct(), ["rec_id", "bucket"], "left_semi")
    low = lambda bucket: F.greatest(bucket * width - extent, F.lit(0))
    start = F.greatest(low(F.col("bucket")), "first_frame")
    part = F.slice("samples", (start - F.col("first_frame") + 1).cast("int"), (F.least((F.col("bucket") + 1) * width + extent, end) - start).cast("int"))
    pieces = blocks.select("rec_id", "bucket", "channel", start.alias("start"), part.alias("part"))
    rows = centres.unionByName(pieces, allowMissingColumns=True)

    def levels(bucket: int, frames: int, n: int, asked: list, held: list) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
        """A bucket's centres in runs, with the targets and their levels (target, centre, bin)."""
        low = max(bucket * width - extent, 0)
        signal = np.zeros((n, (bucket + 1) * width + extent - low))
        known = np.zeros(signal.shape[1], bool)
        for channel, start, part in held:
            signal[channel, start - low : start - low + len(part)] = part
            known[start - low : start - low + len(part)] = True
        if channels == "all" and n > 1:
            targets, heard = list(range(n)), signal
        elif isinstance(channels, int) and channels < n:
            targets, heard = [channels], signal[channels : channels + 1]
        else:
            targets, heard = [None], signal.mean(0, keepdims=True)
        own = np.array(asked)
        before = np.concatenate([[0], np.cumsum(known)])
        ends = [before[np.clip(x - low, 0, len(known))] for x in (np.maximum(own - extent, 0), np.minimum(own + extent, frames))]
        own = own[ends[1] > ends[0]]  # a block reaches them
        run = max(1, AT_ONCE // (AROUND * fft * len(targets)))
        for i in range(0, len(own), run):
            yield own[i : i + run], targets, around_each(heard, low, own[i : i + run], frames, fft)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets stream by, their rows together, centres first: only one bucket's samples are held."""
        out: dict[str, list] = {"rec_id": [], "centre": [], "target": [], "levels": []}

        def made() -> pd.DataFrame:
            pdf = pd.DataFrame(out | {"target": pd.array(out["target"], dtype="Int32")})
            for column in out.values():
                column.clear()
            return pdf

        def bucket(key, head, asked, held) -> Iterator[pd.DataFrame]:
            for own, targets, found in levels(int(key[1]), *head, asked, held) if asked and held else ():
                for target, of in zip(targets, found):
                    out["rec_id"] += [key[0]] * len(own)
                    out["centre"] += own.tolist()
                    out["target"] += [target] * len(own)
                    out["levels"] += list(of)
                if len(out["rec_id"]) * (fft // 2 + 1) >= AT_ONCE:
                    yield made()

        key, head, asked, held = None, (0, 0), [], []
        for pdf in batches:
            for rec, at, centre, frames, n, channel, start, part in zip(*(pdf[c] for c in ("rec_id", "bucket", "centre", "frames", "n", "channel", "start", "part"))):
                if (rec, at) != key:
                    yield from bucket(key, head, asked, held)
                    key, asked, held = (rec, at), [], []
                if part is None:
                    head = int(frames), int(n)
                    asked.append(int(centre))
                else:
                    held.append((int(channel), int(start), part))
        yield from bucket(key, head, asked, held)
        if out["rec_id"]:
            yield made()

    rows = rows.where("rec_id is not null").repartition("rec_id", "bucket").sortWithinPartitions("rec_id", "bucket", F.col("centre").asc_nulls_last())
    found = rows.mapInPandas(work, f"rec_id {dict(rows.dtypes)['rec_id']}, centre long, target int, levels array<double>")
    return marks.select("rec_id", "marker", "centre").join(found, ["rec_id", "centre"]).select("rec_id", "marker", "target", "levels")


def dft_power(samples: Column, n: int) -> Column:
    """The same power by bin for an array of n samples, in built-in functions alone; for small n."""
    window = hann(n)
    scale = (2 / window.sum()) ** 2
    weighted = F.zip_with(samples, F.array(*map(F.lit, window.tolist())), lambda x, w: x * w)

    def bin_(k: Column) -> Column:
        part = lambda wave: F.aggregate(F.transform(weighted, lambda x, i: x * wave(2 * math.pi / n * k * i)), F.lit(0.0), lambda a, b: a + b)
        return (F.pow(part(F.cos), F.lit(2)) + F.pow(part(F.sin), F.lit(2))) * scale

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), bin_)


def band_kept(hz: Column, lo: float, hi: float, bin_hz: float) -> Column:
    """How much of a bin a band lets through: all inside, a raised cosine over two bins outside."""
    out = F.greatest(lo - hz, hz - hi, F.lit(0.0)) / (2 * bin_hz)
    return F.when(out >= 1, 0.0).otherwise(0.5 + 0.5 * F.cos(out * math.pi))


def gated(level: Column, floor: Column, soft: bool) -> Column:
    """0 at or under a floor and 1 above it; softly over 6 dB."""
    if not soft:
        return F.when(level <= floor, 0.0).otherwise(1.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - floor) / 6))
    return t * t * (3 - 2 * t)
