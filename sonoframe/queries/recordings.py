"""Queries over WAV files that the data source writes and reads: `embeddings` as recordings of six kinds of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import dataset as D
from ..views import table

c = F.col

# by vec_id % 6: bits, and whether floating
_KINDS = [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)]
_OF = lambda i, at: "case vec_id % 6 " + " ".join(f"when {k} then {str(x[at]).lower()}" for k, x in enumerate(_KINDS)) + " end"
#: Sizes past this make an RF64 of a file, in place of 2^32.
_LIMIT = 300
_FILES = f"""files as (select vec_id, vec_id || '.wav' as name, 1 + vec_id % 2 channels, {_OF(0, 0)} bits, {_OF(0, 1)} floating, 8000 * (1 + vec_id % 5) rate,
 list_transform(embedding, lambda x: x::double * 3) xs from embeddings)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording as two blocks of interleaved samples, the later one first."""
    kind = lambda at: F.element_at(F.array(*[F.lit(k[at]) for k in _KINDS]), (c("vec_id") % 6 + 1).cast("int"))
    rows = table(spark, sf, "embeddings").select(
        F.concat(c("vec_id").cast("string"), F.lit(".wav")).alias("name"), (1 + c("vec_id") % 2).cast("int").alias("channels"), kind(0).alias("bits"), kind(1).alias("floating"),
        (8000 * (1 + c("vec_id") % 5)).cast("int").alias("sample_rate"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("xs"),
    )
    part = lambda first, n: F.struct((F.lit(first) / c("channels")).cast("long").alias("first_frame"), F.slice("xs", first + 1, n).alias("samples"))
    return rows.withColumn("x", F.explode(F.array(part(20, 44), part(0, 20)))).select("*", "x.*").drop("x", "xs")


def _written(spark: SparkSession, sf: str) -> str:
    folder = D.shared_folder(spark, "recordings")
    D.write_recordings(_blocks(spark, sf), folder, riffbytes=str(_LIMIT))
    return folder


_HEAD = "12 + 36 + 8 + case when bits > 16 and not floating then 40 when floating then 18 else 16 end + case when floating then 12 else 0 end + 8"


@query("recording_headers", f"with {_FILES} select name, case when {_HEAD} + 64 * bits / 8 - 8 > {_LIMIT} then 'RF64' else 'RIFF' end container, rate::bigint sample_rate, channels::bigint channels, bits::bigint bits, floating, (64 // channels)::bigint frames from files")
def recording_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers by ranged reads."""
    rows = D.read_headers(spark, _written(spark, sf), "path string, container string, sample_rate long, channels long, bits long, floating boolean, frames long")
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "container", "sample_rate", "channels", "bits", "floating", "frames")


_WHOLE = "greatest(-(2 ** (bits - 1)), least(2 ** (bits - 1) - 1, round(x * 2 ** (bits - 1)))) / 2 ** (bits - 1)"


@query("recording_blocks", f"""with {_FILES}, s as (select name, channels, bits, floating, unnest(xs) x, unnest(generate_series(0, 63)) i from files)
 select name, (i % channels)::int channel, (i // channels)::bigint frame, round(case when bits = 64 then x when floating then x::float::double else {_WHOLE} end * 1e9)::bigint x
 from s where i // channels between 3 and 52""")
def recording_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Frames 3 to 52 in blocks of 16 frames, from partitions of 5,000 bytes, or more where that would make too many; a
    block's name is taken from its path before its samples become rows."""
    rows = D.read_blocks(spark, _written(spark, sf), first="3", count="50", block="16", partitionBytes="5000")
    rows = rows.withColumn("name", F.substring_index("path", "/", -1)).select("name", "channel", "first_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select("name", "channel", (c("first_frame") + c("i")).alias("frame"), F.round(c("x") * 1e9).cast("long").alias("x"))
