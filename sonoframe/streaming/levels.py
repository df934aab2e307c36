"""Streams of samples: level blocks by event time, and held peaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOLD_SECONDS, FALL_PER_SECOND, FLOOR = 1.5, 15.0, -100.0


def level_windows(samples: DataFrame, window: str, late: str, key: str = "user_id", at: str = "ts", x: str = "x") -> DataFrame:
    """Peak and mean square of each key and tumbling window; rows later than `late` are dropped in a stream."""
    rows = samples.withWatermark(at, late) if samples.isStreaming else samples
    return rows.groupBy(key, F.window(at, window).alias("w")).agg(F.max(F.abs(x)).alias("peak"), F.avg(F.col(x) * F.col(x)).alias("mean_square"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "peak", "mean_square", "n")


def held(levels: list[tuple[float, float]], state: tuple[float, float, float] | None = None) -> tuple[list[float], tuple[float, float, float]]:
    """Peaks (seconds, dB) to what a meter shows: the highest, and once that is 1.5 s old, 15 dB a second less than before."""
    out, (value, since, last) = [], state or (FLOOR, float("inf"), 0.0)
    for at, level in levels:
        if level >= value:
            value, since = level, at
        elif at - since > HOLD_SECONDS:
            value = max(value - FALL_PER_SECOND * max(at - last, 0.0), FLOOR)
        last = at
        out.append(value)
    return out, (value, since, last)


def peak_hold(levels: DataFrame, key: str = "user_id") -> DataFrame:
    """Of (key, at in seconds, level in dB): what each key's meter shows; state is three numbers a key."""

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values("at")
        shown, new = held(list(zip(pdf["at"], pdf["level"])), state.get if state.exists else None)
        state.update(new)
        yield pd.DataFrame({"key": k[0], "at": pdf["at"], "shown": shown})

    rows = levels.select(F.col(key).cast("long").alias("key"), "at", "level")
    return rows.groupBy("key").applyInPandasWithState(work, "key long, at double, shown double", "value double, since double, last double", "append", GroupStateTimeout.NoTimeout)


def peak_hold_batch(levels: DataFrame, key: str = "user_id") -> DataFrame:
    """The same over a finished table: keys' rows stream by in order, so only three numbers of one key are held at a time."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, state = None, None
        for pdf in batches:
            for k, part in pdf.groupby("key", sort=False):
                state = state if k == whose else None
                shown, state = held(list(zip(part["at"], part["level"])), state)
                whose = k
                yield pd.DataFrame({"key": part["key"], "at": part["at"], "shown": shown})

    rows = levels.select(F.col(key).cast("long").alias("key"), "at", "level").where("key is not null and at is not null and level is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "level").mapInPandas(work, "key long, at double, shown double")
