"""Intervals of frames and bands of frequency: merging, lookups and masks by windows and bucketed range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(regions: DataFrame, frames: int, reach: int = 0, key: str = "rec_id") -> DataFrame:
    """Regions (lo, hi) widened by reach, clipped to a recording, and joined where they overlap or touch."""
    lo, hi = F.greatest(F.col("lo") - reach, F.lit(0)), F.least(F.col("hi") + reach, F.lit(frames))
    rows = regions.select(key, lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    order = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(F.col("lo") <= before, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def covering(points: DataFrame, regions: DataFrame, width: int, key: str = "rec_id") -> DataFrame:
    """points (key, frame, ...) with each region (lo, hi, ...) that holds them: a range join by buckets of `width` frames.

    A region stands in every bucket it touches, so no pair outside a shared bucket is formed.
    """
    spread = regions.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    near = points.withColumn("bucket", F.floor(F.col("frame") / width)).join(spread, [key, "bucket"])
    return near.where((F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi"))).drop("bucket")


def into_stretches(points: DataFrame, stretches: DataFrame, key: str = "rec_id") -> DataFrame:
    """Each point's frame moved into the first stretch (lo, hi; disjoint) that ends after it; past the last, to the first
    stretch's start; without stretches it stays.

    An as-of join: points and ends in one order from the last frame back, each point taking the stretch seen last. A
    recording's rows stream by in one pass; no point meets any other stretch.
    """
    first = F.min("lo").over(Window.partitionBy(key))
    ends = stretches.where("lo < hi").select(key, F.col("hi").alias("pos"), F.lit(0).alias("point"), "lo")
    rows = points.where("frame is not null").select(key, F.col("frame").cast("long").alias("pos"), F.lit(1).alias("point"), F.lit(None).cast("long").alias("lo")).unionByName(ends)
    back = Window.partitionBy(key).orderBy(F.desc("pos"), F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("next", F.last("lo", ignorenulls=True).over(back)).withColumn("first", first).where("point = 1")
    return rows.select(key, F.col("pos").alias("frame"), F.when(F.col("next").isNull(), F.coalesce("first", "pos")).otherwise(F.greatest("pos", "next")).alias("moved"))


def topmost(points: DataFrame, regions: DataFrame, width: int, key: str = "rec_id") -> DataFrame:
    """For points (key, frame, hz): the last-drawn region (greatest ord) that holds them, its band's ends included."""
    held = covering(points, regions, width, key).where((F.col("hz") >= F.col("lo_hz")) & (F.col("hz") <= F.col("hi_hz")))
    return held.groupBy(key, "frame", "hz").agg(F.max("ord").alias("ord"))


def masks(points: DataFrame, regions: DataFrame, width: int, bins: list[int], key: str = "rec_id") -> DataFrame:
    """For points (key, frame), the bins (given as frequencies) that some active region lets through."""
    rows = covering(points, regions, width, key).withColumn("hz", F.explode(F.array(*map(F.lit, bins))))
    return rows.where((F.col("hz") >= F.col("lo_hz")) & (F.col("hz") <= F.col("hi_hz"))).groupBy(key, "frame", F.col("hz").cast("long").alias("hz")).agg(F.count("*").alias("regions"))


def extent(regions: DataFrame, frames: int, key: str = "rec_id") -> DataFrame:
    """From the first start to the last end of all regions, with a twentieth more on both sides, within the recording."""
    rows = regions.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("pad", F.floor((F.col("hi") - F.col("lo")) / 20))
    return rows.select(key, F.greatest(F.col("lo") - F.col("pad"), F.lit(0)).alias("lo"), F.least(F.col("hi") + F.col("pad"), F.lit(frames)).alias("hi"))


def level_lookup(points: DataFrame, blocks: DataFrame, block: int, span: int = 1, key: str = "rec_id") -> DataFrame:
    """points (key, frame, ...) with `block`, peak and rms over the `span` frames that end there: those of its block and of
    the blocks before it, as many as the span holds whole, one at least. Past the end is the last block.

    Blocks (key, block, peak, mean_square) weigh alike however many frames they have; missing ones count for nothing.
    """
    many = max(span // block, 1)
    trail = Window.partitionBy(key).orderBy("block").rangeBetween(-(many - 1), 0)
    levels = blocks.select(key, "block", F.max("peak").over(trail).alias("peak"), F.sqrt(F.avg("mean_square").over(trail)).alias("rms"))
    last = blocks.groupBy(key).agg(F.max("block").alias("last"))
    at = points.join(last, key).withColumn("block", F.least(F.expr(f"cast(frame as long) div {block}L"), "last")).drop("last")
    return at.join(levels, [key, "block"])


def cue_texts(points: DataFrame, texts: DataFrame, key: str = "rec_id") -> DataFrame:
    """Cue points (key, id, frame, ord) with their texts (key, id, ord, label, name, note).

    The last text of an id wins and is used once, by the id's first point; a missing label is the name.
    """
    newest = Window.partitionBy(key, "id").orderBy(F.desc("ord"))
    last = texts.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place", "ord").withColumn("turn", F.lit(1))
    turn = F.row_number().over(Window.partitionBy(key, "id").orderBy("ord"))
    rows = points.withColumn("turn", turn).join(last, [key, "id", "turn"], "left")
    return rows.select(key, "id", "frame", F.coalesce(F.nullif("label", F.lit("")), "name").alias("label"), "note")


def keyed(fields: DataFrame, key: str = "rec_id") -> DataFrame:
    """Fields (key, ord, name, value) by name in any case, first seen first, with their distinct values in order."""
    order = lambda c: F.array_sort(F.collect_list(F.struct("ord", c)))
    rows = fields.groupBy(key, F.lower("name").alias("folded")).agg(order("value").alias("v"), F.min(F.struct("ord", "name")).alias("first"))
    return rows.select(key, F.col("first.ord").alias("ord"), F.col("first.name").alias("name"), F.array_distinct(F.transform("v", lambda x: x["value"])).alias("values"))


def distinct_fields(fields: DataFrame, key: str = "rec_id") -> DataFrame:
    """Fields (key, ord, name, value): the first of each name (in any case) and value."""
    first = Window.partitionBy(key, F.lower("name"), "value").orderBy("ord")
    return fields.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
