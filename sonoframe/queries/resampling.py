"""Queries that change recordings' rates and depths: `embeddings` as recordings of two channels, in stretches of a few frames."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resampling as R
from ..registry import query
from ..views import PAIRS, pairs

c = F.col


def _frames(rows: DataFrame, scale: float | None = 1e6) -> DataFrame:
    rows = rows.select("rec_id", "channel", "first_frame", F.posexplode("samples").alias("i", "x"))
    value = F.round(c("x") * scale).cast("long") if scale else c("x")
    return rows.select("rec_id", "channel", (c("first_frame") + c("i")).alias("frame"), value.alias("x"))


_TAPS = "[" + ", ".join(f"{x!r}" for x in R.taps(3).tolist()) + "]"


@query("fir_decimate", f"""with {PAIRS}, kept as (select unnest(generate_series(0, 21)) m)
 select rec_id, channel, m::bigint frame, round(sum(x * h[3 * (m + 1) - 1 - i + 1]) * 1e6)::bigint x from pairs, kept, (select {_TAPS} h) where 3 * (m + 1) - 1 - i between 0 and 48 group by rec_id, channel, m""")
def fir_decimate(spark: SparkSession, sf: str) -> DataFrame:
    blocks, lengths = pairs(spark, sf)
    return _frames(R.decimated(blocks, lengths, 3, width=5))


_NUM, _DEN = 160, 147
_HALF = R.CROSSINGS / R.CUTOFF


@query("resample", f"""with {PAIRS}, spots as (select m, n, m * {_DEN} / {_NUM} - n t from (select unnest(generate_series(0, {64 * _NUM // _DEN - 1})) m), (select unnest(generate_series(-40, 110)) n)),
 taps as (select m, n, case when t = 0 then 1 else sin(pi() * {R.CUTOFF} * t) / (pi() * {R.CUTOFF} * t) end * ({" + ".join(f"{a} * cos({k} * pi() * t / {_HALF!r})" for k, a in enumerate(R.HARRIS))}) h from spots where abs(t) < {_HALF!r}),
 whole as (select m, sum(h) all_h from taps group by m)
 select rec_id, channel, m::bigint frame, round(sum(x * h) / any_value(all_h) * 1e6)::bigint x from pairs join taps on n = i join whole using (m) group by rec_id, channel, m""")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    """From 44.1 to 48 kHz."""
    blocks, lengths = pairs(spark, sf)
    return _frames(R.resampled(blocks, lengths, 44100, 48000, width=25))


@query("resample_length", f"with {PAIRS} select rec_id, channel, (count(*) * 8000 // 11025)::bigint frames, true in_range from pairs group by all")
def resample_length(spark: SparkSession, sf: str) -> DataFrame:
    """A whole conversion: 11,025 to 8,000 Hz, turned down where it peaks, dithered to 8 bits; as many frames as there should be."""
    blocks, lengths = pairs(spark, sf)
    louder = blocks.withColumn("samples", F.transform("samples", lambda x: x * 9))
    rows = _frames(R.converted(louder, lengths, 11025, 8000, 8), None)
    return rows.groupBy("rec_id", "channel").agg(F.count("*").alias("frames"), F.max(c("x").between(-128, 127)).alias("in_range"))


_M64 = (1 << 64) - 1
_DRAWS = f"""draws as (select 0 i, {R.SEED}::hugeint s union all select i + 1, xor(c, c >> 27) from (select i, xor(b, (b << 25) & {_M64}) c from (select i, xor(s, s >> 12) b from draws where i < 256))),
 uniform as (select i - 1 i, ((((s & 4294967295) * {R.STAR} + ((((s >> 32) * {R.STAR & 0xFFFFFFFF}) & 4294967295) << 32)) & {_M64}) >> 11)::double / {2**53} u from draws where i > 0)"""


@query("dither", f"""with recursive {_DRAWS}, {PAIRS} select rec_id, channel, p.i::bigint frame, greatest(-128, least(127, round(x * 2.5 * 128 + a.u - b.u)))::bigint x
 from (select rec_id, channel, p.i, x, 2 * (p.i * channels + channel) d from pairs p join heads using (rec_id)) p join uniform a on a.i = d join uniform b on b.i = d + 1""")
def dither(spark: SparkSession, sf: str) -> DataFrame:
    """At 8 bits, after a gain of 2.5."""
    blocks, lengths = pairs(spark, sf)
    return _frames(R.dithered(blocks, lengths.withColumn("gain", F.lit(2.5)), 8), None)
