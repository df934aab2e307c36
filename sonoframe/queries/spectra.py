"""Queries over spectra: `embeddings` as recordings of 64 frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shaping as H
from ..operators import spectral as P
from ..registry import query
from ..views import PAIRS, pairs, signal, table

c = F.col
_DFT = """(select vec_id rec_id, k, pow(list_sum(list_transform(generate_series(0, {n} - 1), lambda i: x[i + 1] * w[i + 1] * cos(2 * pi() / {n} * k * i))), 2) + pow(list_sum(list_transform(generate_series(0, {n} - 1), lambda i: x[i + 1] * w[i + 1] * sin(2 * pi() / {n} * k * i))), 2) p
 from (select vec_id, {x} x, list_transform(generate_series(0, {n} - 1), lambda i: 0.5 - 0.5 * cos(2 * pi() * i / {n})) w, unnest(generate_series(0, {n} // 2)) k from embeddings))"""
_MILLI = "round(greatest(10 * log10({p}), -200) * 1e3)::bigint"


def _arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(c("vec_id").alias("rec_id"), c("embedding").cast("array<double>").alias("samples"))


@query("spectrum_dft", f"select rec_id, k::bigint bin, round(p * pow(2 / 32.0, 2) * 1e9)::bigint as power from {_DFT.format(n=64, x='embedding::double[]')}")
def spectrum_dft(spark: SparkSession, sf: str) -> DataFrame:
    rows = _arrays(spark, sf).select("rec_id", F.posexplode(P.dft_power(c("samples"), 64)).alias("bin", "p"))
    return rows.select("rec_id", c("bin").cast("long").alias("bin"), F.round(c("p") * 1e9).cast("long").alias("power"))


def _around(marks: str, signal: str, n: int) -> str:
    """Levels around marks (rec_id, marker, target, centre, frames) of signal (rec_id, target, i, x), windows of n frames."""
    extent = P.reach(n)
    return f"""reads as (select m.*, w, greatest(centre - {n // 2 * 7 // 2}, 0) + w * {n // 2} - {n // 2} at0 from {marks} m, (select unnest(generate_series(0, 7)) w)),
 framed as (select r.rec_id, r.marker, r.target, r.w, s.i - at0 j, x * (0.5 - 0.5 * cos(2 * pi() * (s.i - at0) / {n})) x from reads r join {signal} s on r.rec_id = s.rec_id and r.target is not distinct from s.target
  and s.i >= at0 and s.i < at0 + {n} and s.i >= centre - {extent} and s.i < least(centre + {extent}, frames)),
 bins as (select rec_id, marker, target, w, k, pow(sum(x * cos(2 * pi() / {n} * k * j)), 2) + pow(sum(x * sin(2 * pi() / {n} * k * j)), 2) p from framed, (select unnest(generate_series(0, {n // 2})) k) group by all)
 select rec_id, marker, target, k::bigint bin, round(greatest(10 * log10(sum(p) * pow(2 / {n / 2}, 2) / 8), -200) * 1e3)::bigint as level from bins group by all"""


@query("spectrum_avg", f"""with s as (select vec_id rec_id, null::int target, unnest(generate_series(0, 63)) i, unnest(embedding)::double x from embeddings), m as (select vec_id rec_id, 0 marker, null::int target, 28 centre, 64 frames from embeddings),
 {_around("m", "s", 16).replace("select rec_id, marker, target, k::bigint bin", "select rec_id, k::bigint bin")}""".replace("from bins group by all", "from bins group by rec_id, k"))
def spectrum_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Of mono recordings, around frame 28."""
    rows = _arrays(spark, sf).select("rec_id", F.lit(0).alias("channel"), F.lit(0).cast("long").alias("first_frame"), "samples")
    marks = rows.select("rec_id", F.lit(0).alias("marker"), F.lit(28).cast("long").alias("frame"))
    lengths = rows.select("rec_id", F.size("samples").cast("long").alias("frames"), F.lit(1).cast("long").alias("channels"))
    out = P.spectra_at(rows, marks, lengths, 16)
    return out.select("rec_id", F.posexplode("levels").alias("bin", "level")).select("rec_id", c("bin").cast("long").alias("bin"), F.round(c("level") * 1e3).cast("long").alias("level"))


_MARKS = "marks as (select c_custkey % 300 rec_id, c_custkey marker, least(c_custkey * 7 % 80, frames)::int centre, frames, channels from customer join heads on heads.rec_id = c_custkey % 300)"


def _marker_spectra(spark: SparkSession, sf: str, channels: str) -> DataFrame:
    blocks, lengths = pairs(spark, sf)
    marks = table(spark, sf, "customer").select((c("c_custkey") % 300).alias("rec_id"), c("c_custkey").alias("marker"), (c("c_custkey") * 7 % 80).alias("frame"))
    out = P.spectra_at(blocks, marks, lengths, 8, channels)
    out = out.select("rec_id", "marker", "target", F.posexplode("levels").alias("bin", "level"))
    return out.withColumn("bin", c("bin").cast("long")).withColumn("level", F.round(c("level") * 1e3).cast("long"))


@query("marker_spectra", f"with {PAIRS}, {_MARKS}, s as (select rec_id, case when channels > 1 then channel end target, i, x from pairs join heads using (rec_id)), m as (select distinct m.rec_id, marker, target, centre, frames from marks m join s using (rec_id)), {_around('m', 's', 8)}")
def marker_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Of each channel, around customers' frames; some lie past the end."""
    return _marker_spectra(spark, sf, "all")


@query("marker_spectra_mix", f"with {PAIRS}, {_MARKS}, s as (select rec_id, null::int target, i, avg(x) x from pairs group by all), m as (select rec_id, marker, null::int target, centre, frames from marks), {_around('m', 's', 8)}")
def marker_spectra_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _marker_spectra(spark, sf, "mix")


@query("spectrogram_max", f"select rec_id, (w // 4)::bigint as \"column\", k::bigint bin, {_MILLI.format(p='max(p) * pow(2 / 8.0, 2)')} as level from (" + " union all ".join(f"select *, {w} w from " + _DFT.format(n=16, x=(f"embedding[{4 * (2 * w + 1) // 1 - 8 + 1}:{4 * (2 * w + 1) + 8}]::double[]" if w else "[0.0::double, 0, 0, 0] || embedding[1:12]::double[]") + (" || [0.0::double, 0, 0, 0]" if w == 7 else "")) for w in range(8)) + ") group by rec_id, w // 4, k")
def spectrogram_max(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    lengths = rows.groupBy("rec_id").agg((F.max("frame") + 1).alias("frames"))
    out = P.spectrogram(P.blocks(rows, 32), lengths, 2, 16, group=1)
    return out.select("rec_id", "column", F.posexplode("levels").alias("bin", "level")).withColumn("bin", c("bin").cast("long")).withColumn("level", F.round(c("level") * 1e3).cast("long"))


@query("band_keep", "select p_partkey, round(case when o >= 1 then 0 else 0.5 + 0.5 * cos(o * pi()) end * 1e6)::bigint keep from (select p_partkey, greatest(1000 - p_retailprice, p_retailprice - 1300, 0) / 100 o from part)")
def band_keep(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(P.band_kept(c("p_retailprice"), 1000.0, 1300.0, 50.0) * 1e6).cast("long").alias("keep"))


@query("floor_gate", "select event_id, case when value - 200 <= -60 then 0 else 1 end::bigint hard, round(t * t * (3 - 2 * t) * 1e6)::bigint soft from (select event_id, value, greatest(0, least(1, (value - 200 + 60) / 6)) t from events)")
def floor_gate(spark: SparkSession, sf: str) -> DataFrame:
    level = c("value") - 200
    return table(spark, sf, "events").select("event_id", P.gated(level, F.lit(-60.0), False).cast("long").alias("hard"), F.round(P.gated(level, F.lit(-60.0), True) * 1e6).cast("long").alias("soft"))


_N, _RATE, _FLOOR, _BAND = 16, 8000.0, -26.0, (300.0, 3000.0)
_NORM = (2 / sum(math.sin(math.pi * i / _N) for i in range(_N))) ** 2
_KEPT = lambda lo, hi: f"0.5 + 0.5 * cos(pi() * least(1, greatest(0, greatest({lo} - k * {_RATE / _N}, k * {_RATE / _N} - {hi}) / {2 * _RATE / _N})))"


def _stft(apart: bool, soft: bool) -> str:
    """Steps of 16 frames every 4, their bins, gains and inverses, added by frame."""
    t = f"least(1, greatest(0, 10 * log10(greatest(power, 1e-300) / {10 ** (_FLOOR / 10) / _NORM}) / 6))"
    gate = f"{t} * {t} * (3 - 2 * {t})" if soft else f"case when power > {10 ** (_FLOOR / 10) / _NORM} then 1 else 0 end"
    even = "0.25 * coalesce(lag(g) over w, g) + 0.5 * g + 0.25 * coalesce(lead(g) over w, g)" if soft else "g"
    by = "rec_id, channel, step" if apart else "rec_id, step"
    return f"""with {PAIRS}, regions as (select s_suppkey * 2 % 150 rec_id, s_nationkey * 2 lo, s_nationkey * 2 + 8 + s_suppkey % 16 hi, s_suppkey % 6 * 400 lo_hz, s_suppkey % 6 * 400 + 900 hi_hz from supplier),
 steps as (select unnest(generate_series(-3, 15)) step), ks as (select unnest(generate_series(0, 8)) k),
 framed as (select rec_id, channel, step, i - 4 * step j, x * sin(pi() * (i - 4 * step) / {_N}) x from pairs join steps on i >= 4 * step and i < 4 * step + {_N}),
 spectra as (select rec_id, channel, step, k, sum(x * cos(2 * pi() / {_N} * k * j)) re, -sum(x * sin(2 * pi() / {_N} * k * j)) im from framed, ks group by all),
 masks as (select r.rec_id, step, k, max({_KEPT("lo_hz", "hi_hz")}) mask from regions r join steps on 4 * step + 8 >= lo and 4 * step + 8 < hi, ks group by all),
 heard as (select {by}, k, pow(avg(re), 2) + pow(avg(im), 2) power from spectra group by all),
 gates as (select {by}, k, {gate} g from heard), gains as (select {by}, k, {even} g from gates window w as (partition by {by} order by k)),
 shaped as (select s.rec_id, s.channel, s.step, s.k, re * f re, im * f im from (select s.*, g * ({_KEPT(*_BAND)}) * case when s.rec_id in (select rec_id from regions) then coalesce(mask, 0) else 1 end f
  from spectra s join gains using ({by}, k) left join masks m on m.rec_id = s.rec_id and m.step = s.step and m.k = s.k) s),
 frames as (select unnest(generate_series(0, 63)) i),
 back as (select rec_id, channel, i, sin(pi() * (i - 4 * step) / {_N}) / 2 / {_N} * sum(case when k in (0, 8) then 1 else 2 end * (re * cos(2 * pi() / {_N} * k * (i - 4 * step)) - im * sin(2 * pi() / {_N} * k * (i - 4 * step)))) y
  from shaped join frames on i >= 4 * step and i < 4 * step + {_N} group by rec_id, channel, step, i)
 select rec_id, channel, i::bigint frame, round(sum(y) * 1e6)::bigint x from back group by all"""


def _shaped(spark: SparkSession, sf: str, apart: bool, soft: bool) -> DataFrame:
    blocks, lengths = pairs(spark, sf)
    regions = table(spark, sf, "supplier").select((c("s_suppkey") * 2 % 150).alias("rec_id"), (c("s_nationkey") * 2).cast("long").alias("lo"), (c("s_nationkey") * 2 + 8 + c("s_suppkey") % 16).alias("hi"), (c("s_suppkey") % 6 * 400).alias("lo_hz"), (c("s_suppkey") % 6 * 400 + 900).alias("hi_hz"))
    rows = H.shaped(blocks, regions, lengths, _RATE, _N, H.Shown(_FLOOR, _BAND, soft, apart), frames=20)
    rows = rows.select("rec_id", "channel", "first_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select("rec_id", "channel", (c("first_frame") + c("i")).alias("frame"), F.round(c("x") * 1e6).cast("long").alias("x"))


@query("stft_filter", _stft(apart=False, soft=True))
def stft_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' regions, a band and a soft floor over recordings of two channels, in stretches of 20 frames."""
    return _shaped(spark, sf, apart=False, soft=True)


@query("stft_filter_apart", _stft(apart=True, soft=False))
def stft_filter_apart(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a hard floor, each channel by its own level."""
    return _shaped(spark, sf, apart=True, soft=False)
