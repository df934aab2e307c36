"""Markers, drawn regions, track names and running totals of listings.

Defined results: nulls in a corner, a selection or an index count as absent; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marker_from_selection(start: Column, end: Column, cursor: Column) -> tuple[Column, Column]:
    """Frame and length of a new marker: the selection's, else a point at the cursor, else one at the beginning."""
    chosen = start.isNotNull() & end.isNotNull()
    frame = F.when(chosen, start).otherwise(F.coalesce(cursor, F.lit(0)))
    return frame, F.when(chosen, F.greatest(end - start, F.lit(0))).otherwise(F.lit(0))


def marker_order(markers: DataFrame, file: str = "rec_id") -> DataFrame:
    """markers (file, id, frame, ...) with their place in the file, from 1, by frame and then id."""
    return markers.withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy("frame", "id")))


def first_markers(markers: DataFrame, most: int, file: str = "rec_id") -> DataFrame:
    """The first `most` markers of each file, with their place."""
    return marker_order(markers, file).where(F.col("place") <= most)


def next_marker_ids(files: DataFrame, markers: DataFrame, file: str = "rec_id") -> DataFrame:
    """files (file) with next_id: one more than the greatest id of a file's markers, 1 where it has none."""
    greatest = markers.groupBy(file).agg(F.max("id").alias("_most"))
    return files.join(greatest, file, "left").withColumn("next_id", F.coalesce("_most", F.lit(0)).cast("long") + 1).drop("_most")


def drawn_region(x0: Column, y0: Column, x1: Column, y1: Column, nyquist: Column, whole_band: Column) -> tuple[Column, Column, Column, Column]:
    """Frames and band of a region drawn between two corners in any order, no higher than nyquist; whole_band: 0 to nyquist."""
    lo, hi = F.least(y0, y1, nyquist), F.least(F.greatest(y0, y1), nyquist)
    return F.least(x0, x1), F.greatest(x0, x1), F.when(whole_band, F.lit(0.0)).otherwise(lo), F.when(whole_band, nyquist).otherwise(hi)


def shown_floor(brightness: Column, contrast: Column) -> Column:
    """The level under which a spectrogram shows nothing."""
    return -(brightness + contrast)


def track_names(tracks: DataFrame, channels: DataFrame, file: str = "rec_id") -> DataFrame:
    """channels (file, channel from 0) with the name of the last of tracks (file, ord, channel_index from 1, name) that names it.

    Blank names and indexes that no channel has are ignored; of names with the same ord the greatest counts as the last.
    """
    last = tracks.where(F.trim("name") != "").groupBy(file, (F.col("channel_index") - 1).alias("channel")).agg(F.max_by(F.trim("name"), F.struct("ord", F.trim("name"))).alias("track_name"))
    return channels.join(last, [file, "channel"], "left")


def batch_progress(jobs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """How far each batch of jobs (batch, finished, partial 0 to 1) is, 0 to 1: finished ones and the parts of others."""
    part = F.when(F.col("finished"), 1.0).otherwise(F.coalesce(F.col("partial"), F.lit(0.0)))
    return jobs.groupBy(batch).agg(F.count_if("finished").alias("n_finished"), F.count("*").alias("n_jobs"), (F.sum(part) / F.count("*")).alias("progress"))


def asks(filters: DataFrame) -> DataFrame:
    """filters (words, format, since, until, shortest, longest) with whether one asks anything; the kind of date alone doesn't."""
    given = F.coalesce(F.col("words"), F.lit("")) != ""
    given = given | (F.coalesce(F.col("format"), F.lit("Any")) != "Any")
    for name in ("since", "until", "shortest", "longest"):
        given = given | F.col(name).isNotNull()
    return filters.withColumn("asks", given)
