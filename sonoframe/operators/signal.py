"""Sampled signals as long tables (rec_id, channel, frame, x): blocks, envelopes, mixes, gains and filters.

Everything here is grouping or a window by recording, so recordings spread over the cluster; a recording's blocks and
columns are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def given_channels(signal: DataFrame, channels: int) -> DataFrame:
    """Rows (rec_id, channel, frame, x) with `channels` channels: further ones are left out, missing ones repeat the last there is."""
    last = signal.groupBy("rec_id").agg(F.max("channel").alias("last"))
    wanted = last.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn("of", F.least("channel", "last"))
    return wanted.select("rec_id", F.col("channel").cast("int").alias("channel"), "of").join(signal.withColumnRenamed("channel", "of"), ["rec_id", "of"]).drop("of")


def read_frames(signal: DataFrame, first: int, count: int) -> DataFrame:
    """Frames first to first + count - 1 of every recording, zeros where it has none, and how many there are."""
    wanted = signal.select("rec_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1)).cast("array<bigint>")))
    near = signal.where(F.col("frame").between(first, first + count - 1)).select("rec_id", "frame", "x")
    return wanted.join(near, ["rec_id", "frame"], "left").select("rec_id", "frame", F.coalesce("x", F.lit(0.0)).alias("x"), F.col("x").isNotNull().alias("present"))


def mix(signal: DataFrame) -> DataFrame:
    """The mean over channels of each frame."""
    return signal.groupBy("rec_id", "frame").agg(F.avg("x").alias("x"))


def deinterleave(blocks: DataFrame, samples: str, channels: int) -> DataFrame:
    """Rows with an array of interleaved samples to one row a frame and channel."""
    rows = blocks.select("*", F.posexplode(samples).alias("at", "x")).drop(samples)
    return rows.withColumn("channel", F.col("at") % channels).withColumn("frame", F.floor(F.col("at") / channels)).drop("at")


def level_blocks(signal: DataFrame, block: int, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Peak and mean square of each block of frames; a short last block counts its own frames."""
    return signal.groupBy(*keys, F.floor(F.col("frame") / block).alias("block")).agg(F.max(F.abs("x")).alias("peak"), (F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("mean_square"))


def levels_at(blocks: DataFrame, span: int, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """For each block, the peak and RMS of it and the span - 1 blocks before: means of blocks, not of frames."""
    order = Window.partitionBy(*keys).orderBy("block").rowsBetween(-(span - 1), 0)
    return blocks.select(*keys, "block", F.max("peak").over(order).alias("peak"), F.sqrt(F.avg("mean_square").over(order)).alias("rms"))


def envelope(signal: DataFrame, columns: int, frames: int, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Lowest and highest sample of each of `columns` equal stretches; zeros for a stretch without frames."""
    column = F.least(F.floor(F.col("frame") / F.lit(frames / columns)), F.lit(columns - 1))
    found = signal.groupBy(*keys, column.alias("column")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    every = found.select(*keys).distinct().withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<bigint>")))
    return every.join(found, [*keys, "column"], "left").fillna(0.0, ["lo", "hi"])


def reduced(columns: DataFrame, n: int, pixels: int, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """An envelope of n columns drawn on fewer pixels: a pixel takes every column that it touches."""
    per = F.lit(n / pixels)
    first = F.floor(F.col("column") / per)
    last = F.least(F.ceil((F.col("column") + 1) / per) - 1, F.lit(pixels - 1))
    rows = columns.withColumn("pixel", F.explode(F.sequence(first, F.greatest(first, last))))
    return rows.groupBy(*keys, "pixel").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def peaks(signal: DataFrame) -> DataFrame:
    return signal.groupBy("rec_id").agg(F.max(F.abs("x")).alias("peak"))


def fit_gain(peak: Column) -> Column:
    """The gain that brings a peak over full scale down to it."""
    return F.when(peak > 1, 1 / peak).otherwise(1.0)


def quantised(x: Column, bits: int) -> Column:
    """The nearest whole number of a sample at a depth, halves away from zero, within its range."""
    full = 2 ** (bits - 1)
    return F.greatest(F.lit(-full), F.least(F.lit(full - 1), F.round(x * full))).cast("long")


def widened(sample: Column, bits: int, to: int) -> Column:
    return F.shiftleft(sample.cast("long"), to - bits)


def smoothed(signal: DataFrame) -> DataFrame:
    """Each value with its neighbours by a quarter, a half and a quarter; edges stand for their missing neighbour."""
    order = Window.partitionBy("rec_id").orderBy("frame")
    before, after = F.coalesce(F.lag("x").over(order), "x"), F.coalesce(F.lead("x").over(order), "x")
    return signal.select("rec_id", "frame", (0.25 * before + 0.5 * F.col("x") + 0.25 * after).alias("x"))


def crossfaded(a: DataFrame, b: DataFrame, start: int, n: int) -> DataFrame:
    """a up to frame start + n, b from start on, blended where both are: b's weight grows from 1/(n+1) to n/(n+1)."""
    both = a.withColumnRenamed("x", "a").join(b.withColumnRenamed("x", "b"), ["rec_id", "frame"])
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("frame") - start + 1) / (n + 1)))
    return both.select("rec_id", "frame", (F.col("a") * (1 - weight) + F.col("b") * weight).alias("x"))


def mixdown(signal: DataFrame, gains: DataFrame) -> DataFrame:
    """Left and right of each frame, from gains (channel, left, right); channels without gains are silent."""
    return signal.join(gains, "channel").groupBy("rec_id", "frame").agg(F.sum(F.col("x") * F.col("left")).alias("left"), F.sum(F.col("x") * F.col("right")).alias("right"))


def speaker_gains(channels: int, muted: set[int], both: bool) -> list[tuple[int, float, float]]:
    """(channel, left, right): mono goes to both sides, and so, shared among those heard, do channels with `both` where
    one is muted; else even channels go left, odd right."""
    heard = [c for c in range(channels) if c not in muted]
    if channels == 1 or both and len(heard) < channels:
        return [(c, 1 / len(heard), 1 / len(heard)) if c in heard else (c, 0.0, 0.0) for c in range(channels)] if heard else [(c, 0.0, 0.0) for c in range(channels)]
    sides = ((channels + 1) // 2, channels // 2)
    return [(c, 0.0, 0.0) if c in muted else (c, 1 / sides[0] if c % 2 == 0 else 0.0, 1 / sides[1] if c % 2 else 0.0) for c in range(channels)]


def colour_index(level: Column, brightness: float, contrast: float) -> Column:
    """The place of a level in a table of 256 colours."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level + brightness) / contrast + 1)) * 255).cast("long")


def between_bins(levels: Column, bin_: Column, bins: int) -> Column:
    """The level at a place between two bins, by a line between theirs; the outermost two go on."""
    below = F.least(F.greatest(F.floor(bin_), F.lit(0)), F.lit(bins - 2)).cast("int")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), bin_ - below))
    a, b = F.get(levels, below), F.get(levels, below + 1)
    return a + (b - a) * t


def picture_rows(levels: Column, bins: int, bin_hz: float, lo: float, hi: float, logarithmic: bool, rows: int, brightness: float, contrast: float) -> Column:
    """A column of a picture, `rows` colours from the highest frequency down: a row that is a bin tall or more shows the
    loudest bin it covers, a shorter one the level between the two bins nearest its middle."""
    at = lambda t: lo * F.pow(F.lit(hi / lo), t) if logarithmic else lo + (hi - lo) * t

    def one(row: Column) -> Column:
        top, bottom, middle = at(1 - row / rows), at(1 - (row + 1) / rows), at(1 - (row + 0.5) / rows)
        first = F.least(F.floor(bottom / bin_hz), F.lit(bins - 1)).cast("int")
        last = F.least(F.greatest(F.ceil(top / bin_hz).cast("int"), first + 1), F.lit(bins))
        loudest = F.greatest(F.array_max(F.slice(levels, first + 1, last - first)), F.lit(-200.0))
        return colour_index(F.when(top - bottom < bin_hz, between_bins(levels, middle / bin_hz, bins)).otherwise(loudest), brightness, contrast)

    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), one)


def pcm_md5(samples: Column, bits: int) -> Column:
    """The MD5 of whole samples as little-endian signed numbers of as many bytes as `bits` take."""
    byte = lambda x, i: F.substring(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) + F.lit(256)), 2, 2)
    return F.md5(F.unhex(F.array_join(F.transform(samples, lambda x: F.concat(*[byte(x.cast("long"), i) for i in range(-(-bits // 8))])), "")))
