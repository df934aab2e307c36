"""Fields and markers of recordings: names, key rules, edits against stored versions, positions on a loop and a timeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def description(*candidates: Column) -> Column:
    """The first of several texts that people wrote."""
    from ..functions.text import human_text

    return F.coalesce(*map(human_text, candidates))


def wall_start(time_reference: Column, rate: Column, clock: Column, date: Column) -> tuple[Column, Column]:
    """A recording's start: seconds since midnight from its sample count, or else its clock; its date, if it is ten characters."""
    from ..functions.numbers import clock_seconds

    seconds = F.when(time_reference > 0, time_reference / rate).otherwise(clock_seconds(clock))
    day = F.translate(F.trim(date), ":/.", "---")
    return seconds, F.when(F.length(day) == 10, day)


def applied(stored: DataFrame, saved: DataFrame, edited: DataFrame, key: str = "rec_id") -> DataFrame:
    """Edits by ordinal, from tables (key, ord, name, value): the stored tag as read (saved) with what was edited.

    A tag that changed since it was read isn't touched: its rows come with conflict true. Rows that edits lack are
    dropped, rows with a new ordinal are added.
    """
    side = lambda df, n: df.select(key, "ord", F.struct("name", "value").alias(n))
    both = side(stored, "now").join(side(saved, "then"), [key, "ord"], "full_outer")
    changed = both.groupBy(key).agg(F.max((~F.col("now").eqNullSafe(F.col("then"))).cast("int")).alias("changed"))
    plain = edited.join(changed, key, "left").where("coalesce(changed, 0) = 0").select(key, "ord", "name", "value", F.lit(False).alias("conflict"))
    kept = stored.join(changed.where("changed = 1").select(key), key).select(key, "ord", "name", "value", F.lit(True).alias("conflict"))
    return plain.unionByName(kept)


def advanced(position: Column, step: Column, stretches: list[tuple[int, int]]) -> Column:
    """A position moved on by a step; what goes past a stretch's end goes on in the next, after the last in the first."""
    out = position + step
    for i in reversed(range(len(stretches))):
        (_, end), (following, _) = stretches[i], stretches[(i + 1) % len(stretches)]
        moved = F.when(position + step >= end, following + position + step - end).otherwise(position + step)
        out = F.when(position < end, moved).otherwise(out)
    return out


def timeline(packets: DataFrame, most: int, key: str = "rec_id") -> DataFrame:
    """Of packets (key, ord, at, frames): where each one's frames go, and how many of them are skipped.

    A packet ahead of what is expected leaves a gap, unless it is more than `most` frames ahead: then it follows at
    once. Frames that overlap what is already placed are skipped. Each place depends on all before it, so a
    recording's packets pass one task in order, batch by batch; only the expected place is held. Packets with a null
    are left out; packets of the same ordinal are placed by where they claim to be, then by length.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, expected = None, None
        for batch in batches:
            placed, skipped = [], []
            for rec, at, frames in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "frames"))):
                start = expected if rec == current and expected is not None else at
                gap = at - start if 0 <= at - start <= most else 0
                skip = min(start - at, frames) if at < start else 0
                placed.append(start + gap)
                skipped.append(skip)
                current, expected = rec, start + gap + frames - skip
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(placed, pa.int64()), pa.array(skipped, pa.int64())], ["key", "ord", "placed", "skipped"])

    rows = packets.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("long").alias(c) for c in ("ord", "at", "frames")]).dropna()
    rows = rows.repartition("key").sortWithinPartitions("key", "ord", "at", "frames")
    return rows.mapInArrow(place, "key long, ord long, placed long, skipped long")


#: The fewest and most columns and rows of a picture, and the most pixels of all its lanes.
FEWEST_COLUMNS, MOST_COLUMNS, FEWEST_ROWS, MOST_ROWS, MOST_PIXELS = 4096, 16384, 2048, 8192, 64_000_000


def picture_size(length: Column, fft: int, bins: Column, share: Column, lanes: Column) -> tuple[Column, Column]:
    """Columns and rows of each lane of an exported picture, of `length` frames.

    A column is a quarter window. The file holds `bins` bins in the lowest `share` of a lane: a row a bin there, and
    the rest of the lane in proportion. Both stay between the fewest and the most, and all lanes within the pixels.
    """
    held = F.greatest(bins, F.lit(FEWEST_ROWS))
    rows = F.when(share > 0, F.least(F.greatest(F.ceil(held / share), F.least(held, F.lit(MOST_ROWS))), F.lit(MOST_ROWS))).otherwise(F.lit(FEWEST_ROWS)).cast("long")
    columns = F.greatest(F.ceil(length / max(fft // 4, 1)), F.least(length, F.lit(FEWEST_COLUMNS)))
    room = F.floor(MOST_PIXELS / (rows * F.greatest(lanes, F.lit(1))))
    return F.greatest(F.least(columns, F.lit(MOST_COLUMNS), room), F.lit(1)).cast("long"), rows


def distinct_pictures(pictures: DataFrame, key: str = "rec_id") -> DataFrame:
    """The first of each recording's pictures (key, ord, content) with the same bytes."""
    first = Window.partitionBy(key, F.md5("content")).orderBy("ord")
    return pictures.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def _crc_table(poly: int, bits: int) -> list[int]:
    table = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) if c >> (bits - 1) & 1 else c << 1
        table.append(c & ((1 << bits) - 1))
    return table


def checksums(rows: DataFrame, key: str, content: str) -> DataFrame:
    """The CRC-8 (polynomial 07) and CRC-16 (8005) of each row's bytes."""
    small, large = _crc_table(0x07, 8), _crc_table(0x8005, 16)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data in pdf["content"]:
                a = b = 0
                for byte in bytes(data):
                    a, b = small[a ^ byte], (b << 8 & 0xFFFF) ^ large[b >> 8 ^ byte]
                out.append((a, b))
            yield pd.DataFrame({"key": pdf["key"], "crc8": [x[0] for x in out], "crc16": [x[1] for x in out]})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(work, f"key {kind}, crc8 long, crc16 long")
