"""The test tables seen as what this library works on: signals, listings, dates and intervals.

Each view comes with the SQL that makes the same rows, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("wav", "mp3", "FLAC", "txt", "WAV", "ogg")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as recordings of 64 frames: rec_id, channel, frame, x."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("label").alias("channel"), F.posexplode("embedding").alias("frame", "x"))
    return rows.select("rec_id", "channel", F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"))


SIGNAL = """signal as (select vec_id rec_id, label channel, unnest(generate_series(0, len(embedding) - 1))::bigint frame, unnest(embedding)::double x from embeddings)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one recording a user, frames in time order: rec_id, frame, x."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), (F.col("value") / 400).alias("x"))


SERIES = """series as (select user_id rec_id, row_number() over (partition by user_id order by ts, event_id) - 1 frame, value / 400 x from events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a listing: rec_id, folder, name, extension (lower case), path, bytes, seconds."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS)).cast("int") + 1)
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("."), ext)
    folder = F.concat(F.lit("/lib/"), "p_brand")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rec_id"), folder.alias("folder"), name.alias("name"), F.lower(ext).alias("extension"),
        F.concat(folder, F.lit("/"), name).alias("path"), (F.col("p_size") * 1000 + F.col("p_partkey")).cast("long").alias("bytes"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("seconds"), F.col("p_type").alias("title"),
    )


FILES = """files as (select p_partkey rec_id, '/lib/' || p_brand folder, p_name || ' ' || p_partkey || '.' || ext as name, lower(ext) extension,
 '/lib/' || p_brand || '/' || p_name || ' ' || p_partkey || '.' || ext path, (p_size * 1000 + p_partkey)::bigint bytes,
 case when p_partkey % 7 <> 0 then p_size::double end as seconds, p_type as title
 from (select *, ['wav','mp3','FLAC','txt','WAV','ogg'][p_partkey % 6 + 1] ext from part))"""


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders' dates as people type them, in seven precisions and forms: rec_id, stamp."""
    d = F.col("o_orderdate")
    form = lambda p: F.date_format(d, p)
    kinds = [form("yyyy-MM-dd'T'HH:mm:ss"), form("yyyy"), form("yyyy-MM"), form("yyyy:MM:dd"), form("d.M.yyyy"), F.concat(form("yyyy/MM/dd"), F.lit(" 21:30")), F.concat(form("yyyy-MM-dd"), F.lit(" 25:00"))]
    text = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        text = F.when(F.col("o_orderkey") % 7 == i, kind).otherwise(text)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), text.alias("stamp"), d.alias("moment"))


STAMPS = """stamps as (select o_orderkey rec_id, o_orderdate as moment, case o_orderkey % 7
 when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 1 then strftime(o_orderdate, '%Y') when 2 then strftime(o_orderdate, '%Y-%m')
 when 3 then strftime(o_orderdate, '%Y:%m:%d') when 4 then day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate)
 when 5 then strftime(o_orderdate, '%Y/%m/%d') || ' 21:30' else strftime(o_orderdate, '%Y-%m-%d') || ' 25:00' end stamp from orders)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as regions of an order's recording: rec_id, ord, lo, hi (frames), lo_hz, hi_hz."""
    lo = (F.col("l_quantity") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").cast("long").alias("ord"), F.col("l_partkey").alias("key"), lo.alias("lo"), (lo + F.col("l_partkey") % 1500 + 1).alias("hi"),
        ((F.col("l_suppkey") % 10) * 1000).cast("long").alias("lo_hz"), ((F.col("l_suppkey") % 10) * 1000 + 4000).cast("long").alias("hi_hz"),
    )


INTERVALS = """intervals as (select l_orderkey rec_id, l_linenumber::bigint ord, l_partkey as key, (l_quantity * 100)::bigint lo, (l_quantity * 100)::bigint + l_partkey % 1500 + 1 hi,
 ((l_suppkey % 10) * 1000)::bigint lo_hz, ((l_suppkey % 10) * 1000 + 4000)::bigint hi_hz from lineitem)"""


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """embeddings as recordings of two channels (the last may have one) and 64 frames, in blocks of 24; their lengths."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("rec_id"), (F.col("vec_id") % 2).cast("int").alias("channel"), F.col("embedding").cast("array<double>").alias("x"))
    part = lambda first: F.struct(F.lit(first).cast("long").alias("first_frame"), F.slice("x", first + 1, 24).alias("samples"))
    blocks = rows.withColumn("b", F.explode(F.array(part(0), part(24), part(48)))).select("rec_id", "channel", "b.*")
    return blocks, rows.groupBy("rec_id").agg(F.lit(64).cast("long").alias("frames"), F.countDistinct("channel").alias("channels"))


PAIRS = """pairs as (select vec_id // 2 rec_id, (vec_id % 2)::int channel, unnest(generate_series(0, 63)) i, unnest(embedding)::double x from embeddings),
 heads as (select rec_id, 64 frames, count(distinct channel) channels from pairs group by rec_id)"""
