"""Queries over signals and intervals: `embeddings` and `events` as recordings, `lineitem` as regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import signal as S
from ..registry import query
from ..views import INTERVALS, SERIES, SIGNAL, intervals, series, signal, table

c = F.col


def _r(x, scale: float = 1e6):
    return F.round(x * scale).cast("long")


@query("read_frames", f"with {SIGNAL} select rec_id, g.frame::bigint frame, round(coalesce(x, 0) * 1e6)::bigint x, x is not null present from (select distinct rec_id from signal) cross join (select unnest(generate_series(60, 69)) frame) g left join signal s using (rec_id, frame)")
def read_frames(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_frames(signal(spark, sf), 60, 10).withColumn("x", _r(c("x")))


@query("mix_target", f"with {SIGNAL} select rec_id % 50 rec_id, frame, round(avg(x) * 1e6)::bigint x from signal group by all")
def mix_target(spark: SparkSession, sf: str) -> DataFrame:
    return S.mix(signal(spark, sf).withColumn("rec_id", c("rec_id") % 50)).withColumn("x", _r(c("x")))


@query("deinterleave", f"with {SIGNAL} select rec_id, (frame % 2)::int channel, frame // 2 frame, round(x * 1e6)::bigint x from signal")
def deinterleave(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(c("vec_id").alias("rec_id"), "embedding")
    return S.deinterleave(rows, "embedding", 2).withColumn("x", _r(c("x").cast("double")))


@query("level_blocks", f"with {SERIES} select rec_id, frame // 10 as block, round(max(abs(x)) * 1e6)::bigint peak, round(sum(x * x) / count(*) * 1e6)::bigint mean_square from series group by all")
def level_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return S.level_blocks(series(spark, sf), 10).withColumn("peak", _r(c("peak"))).withColumn("mean_square", _r(c("mean_square")))


@query("level_at", f"with {SERIES}, b as (select rec_id, frame // 10 as block, max(abs(x)) p, sum(x * x) / count(*) m from series group by all) select rec_id, block, round(max(p) over w * 1e6)::bigint peak, round(sqrt(avg(m) over w) * 1e6)::bigint rms from b window w as (partition by rec_id order by block rows 2 preceding)")
def level_at(spark: SparkSession, sf: str) -> DataFrame:
    return S.levels_at(S.level_blocks(series(spark, sf), 10), 3).withColumn("peak", _r(c("peak"))).withColumn("rms", _r(c("rms")))


@query("level_lookup", f"""with {SERIES}, b as (select rec_id, frame // 10 as block, max(abs(x)) p, sum(x * x) / count(*) m from series group by all), n as (select rec_id, max(block) last from b group by rec_id),
 s as (select rec_id, frame, least(frame * 3 // 10, last) pos from series join n using (rec_id))
 select s.rec_id, s.frame, pos as block, round(max(p) * 1e6)::bigint peak, round(sqrt(avg(m)) * 1e6)::bigint rms from s join b on s.rec_id = b.rec_id and b.block between pos - 2 and pos group by s.rec_id, s.frame, pos""")
def level_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Levels over 35 frames, of blocks of 10; two thirds of the points lie past the end."""
    rows = series(spark, sf)
    points = rows.select("rec_id", c("frame").alias("at"), (c("frame") * 3).alias("frame"))
    return I.level_lookup(points, S.level_blocks(rows, 10), 10, 35).select("rec_id", c("at").alias("frame"), "block", _r(c("peak")).alias("peak"), _r(c("rms")).alias("rms"))


@query("envelope", f"with {SIGNAL}, f as (select rec_id, least(floor(frame / 6.4), 9)::bigint col, min(x) lo, max(x) hi from signal group by all) select rec_id, col as \"column\", round(lo * 1e6)::bigint lo, round(hi * 1e6)::bigint hi from f")
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return S.envelope(signal(spark, sf), 10, 64).withColumn("lo", _r(c("lo"))).withColumn("hi", _r(c("hi")))


@query("waveform_reduce", f"with {SIGNAL}, f as (select rec_id, frame // 4 col, min(x) lo, max(x) hi from signal group by all), p as (select *, unnest(generate_series(floor(col / 3.2)::bigint, least(ceil((col + 1) / 3.2) - 1, 4)::bigint)) pixel from f) select rec_id, pixel, round(min(lo) * 1e6)::bigint lo, round(max(hi) * 1e6)::bigint hi from p group by all")
def waveform_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return S.reduced(S.envelope(signal(spark, sf), 16, 64), 16, 5).withColumn("lo", _r(c("lo"))).withColumn("hi", _r(c("hi")))


@query("peak_scan", f"with {SIGNAL} select rec_id, round(max(abs(x)) * 1e6)::bigint peak, round(case when max(abs(x)) * 5 > 1 then 1 / (max(abs(x)) * 5) else 1 end * 1e6)::bigint gain from signal group by rec_id")
def peak_scan(spark: SparkSession, sf: str) -> DataFrame:
    return S.peaks(signal(spark, sf)).select("rec_id", _r(c("peak")).alias("peak"), _r(S.fit_gain(c("peak") * 5)).alias("gain"))


@query("quantise", f"with {SIGNAL} select rec_id, frame, greatest(-32768, least(32767, round(x * 4 * 32768)))::bigint s16, greatest(-32768, least(32767, round(x * 4 * 32768)))::bigint * 256 s24 from signal")
def quantise(spark: SparkSession, sf: str) -> DataFrame:
    s16 = S.quantised(c("x") * 4, 16)
    return signal(spark, sf).select("rec_id", "frame", s16.alias("s16"), S.widened(s16, 16, 24).alias("s24"))


@query("smooth3", f"with {SIGNAL} select rec_id, frame, round((0.25 * coalesce(lag(x) over w, x) + 0.5 * x + 0.25 * coalesce(lead(x) over w, x)) * 1e6)::bigint x from signal window w as (partition by rec_id order by frame)")
def smooth3(spark: SparkSession, sf: str) -> DataFrame:
    return S.smoothed(signal(spark, sf)).withColumn("x", _r(c("x")))


@query("crossfade_join", f"with {SIGNAL} select rec_id, frame, round((x * (1 - w) + -x * w) * 1e6)::bigint x from (select *, greatest(0, least(1, (frame - 20 + 1) / 11)) w from signal)")
def crossfade_join(spark: SparkSession, sf: str) -> DataFrame:
    a = signal(spark, sf).select("rec_id", "frame", "x")
    return S.crossfaded(a, a.withColumn("x", -c("x")), 20, 10).withColumn("x", _r(c("x")))


@query("mixdown", f"with {SIGNAL} select rec_id // 4 rec_id, frame, round(sum(case rec_id % 4 when 0 then x * 0.5 when 2 then x * 0.5 else 0 end) * 1e6)::bigint as left, round(sum(case rec_id % 4 when 3 then x * 0.5 else 0 end) * 1e6)::bigint as right from signal group by all".replace("as left", 'as "left"').replace("as right", 'as "right"'))
def mixdown(spark: SparkSession, sf: str) -> DataFrame:
    gains = spark.createDataFrame(S.speaker_gains(4, {1}, False), "channel long, left double, right double")
    rows = signal(spark, sf).withColumn("channel", c("rec_id") % 4).withColumn("rec_id", F.floor(c("rec_id") / 4))
    return S.mixdown(rows, F.broadcast(gains)).withColumn("left", _r(c("left"))).withColumn("right", _r(c("right")))  # a row a channel


@query("colour_index", f"with {SIGNAL} select rec_id, frame, floor(greatest(0, least(1, (x * 200 - 60 + 10) / 90 + 1)) * 255)::bigint colour from signal")
def colour_index(spark: SparkSession, sf: str) -> DataFrame:
    return signal(spark, sf).select("rec_id", "frame", S.colour_index(c("x") * 200 - 60, 10.0, 90.0).alias("colour"))


@query("level_interp", "select vec_id rec_id, round((embedding[b + 1]::double + (embedding[b + 2]::double - embedding[b + 1]::double) * least(1, greatest(0, p - b))) * 1e6)::bigint x from (select *, least(greatest(floor(p), 0), 62)::int b from (select vec_id, embedding, vec_id % 131 / 2.0::double - 0.75 p from embeddings))")
def level_interp(spark: SparkSession, sf: str) -> DataFrame:
    """At places from before the first bin to past the last."""
    at = (c("vec_id") % 131) / 2 - 0.75
    return table(spark, sf, "embeddings").select(c("vec_id").alias("rec_id"), _r(S.between_bins(c("embedding").cast("array<double>"), at, 64)).alias("x"))


_ROWS = 9
_AT = lambda t: f"(40 * pow(4000 / 40.0, {t}))"


@query("picture_rows", f"""with r as (select r, {_AT(f"1 - r / {_ROWS}.0")} top, {_AT(f"1 - (r + 1) / {_ROWS}.0")} bottom, {_AT(f"1 - (r + 0.5) / {_ROWS}.0")} / 62.5 mid from (select unnest(generate_series(0, {_ROWS - 1})) r)),
 b as (select *, least(floor(bottom / 62.5), 63)::int first, least(greatest(ceil(top / 62.5)::int, least(floor(bottom / 62.5), 63)::int + 1), 64) last, least(greatest(floor(mid), 0), 62)::int below from r),
 l as (select vec_id rec_id, r, case when top - bottom < 62.5 then x[below + 1] + (x[below + 2] - x[below + 1]) * least(1, greatest(0, mid - below)) else greatest(list_max(x[first + 1:last]), -200) end as level from b, (select vec_id, list_transform(embedding, lambda v: v::double * 300 - 60) x from embeddings))
 select rec_id, r::int as "row", floor(greatest(0, least(1, (level + 10) / 90 + 1)) * 255)::bigint colour from l""")
def picture_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A log axis from 40 to 4000 Hz in nine rows: the low ones are less than a bin tall, the high ones many."""
    levels = F.transform("embedding", lambda v: v.cast("double") * 300 - 60)
    rows = S.picture_rows(levels, 64, 62.5, 40.0, 4000.0, True, _ROWS, 10.0, 90.0)
    return table(spark, sf, "embeddings").select(c("vec_id").alias("rec_id"), F.posexplode(rows).alias("row", "colour"))


@query("given_channels", "with p as (select vec_id // 2 rec_id, (vec_id % 2)::int channel, unnest(generate_series(0, 63))::bigint frame, unnest(embedding)::double x from embeddings), n as (select rec_id, max(channel) last from p group by rec_id), w as (select unnest([0, 1, 2])::int c) select rec_id, c channel, frame, round(x * 1e6)::bigint x from p join n using (rec_id) join w on p.channel = least(c, last)")
def given_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Three channels of recordings of two, or one."""
    rows = signal(spark, sf).withColumn("channel", (c("rec_id") % 2).cast("int")).withColumn("rec_id", F.floor(c("rec_id") / 2))
    return S.given_channels(rows, 3).select("rec_id", "channel", "frame", _r(c("x")).alias("x"))


_PCM = "md5(unhex(array_to_string(list_transform(embedding, lambda x: {bytes}), '')))"
_BYTES = lambda bits: " || ".join(f"printf('%02x', (greatest(-{2 ** (bits - 1)}, least({2 ** (bits - 1) - 1}, round(x::double * {2 ** (bits - 1)})))::bigint >> {8 * i}) & 255)" for i in range(bits // 8))


@query("md5_pcm", f"select vec_id rec_id, {_PCM.format(bytes=_BYTES(16))} as digest, {_PCM.format(bytes=_BYTES(24))} as digest_24 from embeddings")
def md5_pcm(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda bits: S.pcm_md5(F.transform("embedding", lambda x: S.quantised(x.cast("double"), bits)), bits)
    return table(spark, sf, "embeddings").select(c("vec_id").alias("rec_id"), of(16).alias("digest"), of(24).alias("digest_24"))


_MERGED = """r as (select rec_id, greatest(lo - 64, 0) lo, least(hi + 64, 6000) hi from intervals where greatest(lo - 64, 0) < least(hi + 64, 6000)),
 f as (select *, case when lo <= max(hi) over (partition by rec_id order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end fresh from r),
 g as (select *, sum(fresh) over (partition by rec_id order by lo, hi rows unbounded preceding) island from f),
 stretches as (select rec_id, min(lo) lo, max(hi) hi from g group by rec_id, island)"""


@query("segments_merge", f"with {INTERVALS}, {_MERGED} select rec_id, lo, hi from stretches")
def segments_merge(spark: SparkSession, sf: str) -> DataFrame:
    return I.merged(intervals(spark, sf), 6000, 64)


@query("into_stretches", f"""with {INTERVALS}, {_MERGED}, p as (select distinct rec_id, (key * 37) % 7000 frame from intervals)
 select p.rec_id, p.frame, case when min(hi) is null then p.frame when count(case when p.frame < hi then 1 end) > 0 then greatest(p.frame, min(case when p.frame < hi then lo end)) else min(lo) end moved from p left join stretches s using (rec_id) group by p.rec_id, p.frame""")
def into_stretches(spark: SparkSession, sf: str) -> DataFrame:
    rows = intervals(spark, sf)
    points = rows.select("rec_id", (c("key") * 37 % 7000).alias("frame")).distinct()
    return I.into_stretches(points, I.merged(rows, 6000, 64))


_POINTS = "p as (select distinct rec_id, (key * 53) % 6000 frame, ((key * 7) % 14) * 1000 hz from intervals)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return intervals(spark, sf).select("rec_id", (c("key") * 53 % 6000).alias("frame"), (c("key") * 7 % 14 * 1000).alias("hz")).distinct()


@query("region_at", f"with {INTERVALS}, {_POINTS} select p.rec_id, frame, hz, max(ord) ord from p join intervals i on p.rec_id = i.rec_id and frame >= lo and frame < hi and hz between lo_hz and hi_hz group by all")
def region_at(spark: SparkSession, sf: str) -> DataFrame:
    return I.topmost(_points(spark, sf), intervals(spark, sf).drop("key"), 512)


@query("region_mask", f"with {INTERVALS}, {_POINTS}, q as (select distinct rec_id, frame from p) select q.rec_id, frame, b.hz::bigint hz, count(*)::bigint regions from q join intervals i on q.rec_id = i.rec_id and frame >= lo and frame < hi join (select unnest([500, 3000, 6000, 9000]) hz) b on b.hz between lo_hz and hi_hz group by all")
def region_mask(spark: SparkSession, sf: str) -> DataFrame:
    return I.masks(_points(spark, sf).select("rec_id", "frame").distinct(), intervals(spark, sf), 512, [500, 3000, 6000, 9000])


@query("zoom_extent", f"with {INTERVALS} select rec_id, greatest(min(lo) - (max(hi) - min(lo)) // 20, 0) lo, least(max(hi) + (max(hi) - min(lo)) // 20, 6000) hi from intervals group by rec_id")
def zoom_extent(spark: SparkSession, sf: str) -> DataFrame:
    return I.extent(intervals(spark, sf), 6000)


@query("cue_adtl_join", f"with {INTERVALS}, one as (select rec_id, ord, min(key) as key, min(lo) lo from intervals group by all), points as (select rec_id, key % 3 id, lo frame, ord from one), texts as (select rec_id, key % 3 id, ord, case when ord % 2 = 0 then '' else 'l' || ord end label, 'n' || ord as name, 'note ' || key note from one where key % 4 > 0), last as (select * from texts qualify row_number() over (partition by rec_id, id order by ord desc) = 1), turns as (select *, row_number() over (partition by rec_id, id order by ord) turn from points) select t.rec_id, t.id, t.frame, coalesce(nullif(l.label, ''), l.name) label, l.note from turns t left join last l on t.rec_id = l.rec_id and t.id = l.id and t.turn = 1")
def cue_adtl_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = intervals(spark, sf).groupBy("rec_id", "ord").agg(F.min("key").alias("key"), F.min("lo").alias("lo")).withColumn("id", c("key") % 3)
    texts = rows.where("key % 4 > 0").select("rec_id", "id", "ord", F.when(c("ord") % 2 == 0, "").otherwise(F.concat(F.lit("l"), c("ord").cast("string"))).alias("label"), F.concat(F.lit("n"), c("ord").cast("string")).alias("name"), F.concat(F.lit("note "), c("key").cast("string")).alias("note"))
    return I.cue_texts(rows.select("rec_id", "id", c("lo").alias("frame"), "ord"), texts)


_FIELDS = "fields as (select event_id % 40 rec_id, event_id ord, case when event_id % 2 = 0 then upper(event_type) else event_type end as name, (event_id % 5)::varchar as value from events)"


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(c("event_id") % 2 == 0, F.upper("event_type")).otherwise(c("event_type"))
    return table(spark, sf, "events").select((c("event_id") % 40).alias("rec_id"), c("event_id").alias("ord"), name.alias("name"), (c("event_id") % 5).cast("string").alias("value"))


@query("keyed_multi", f"with {_FIELDS}, d as (select rec_id, lower(name) folded, value, min(ord) ord from fields group by all), n as (select rec_id, lower(name) folded, arg_min(name, ord) as name, min(ord) ord from fields group by all) select n.rec_id, n.ord, n.name, string_agg(d.value, ',' order by d.ord) vals from n join d using (rec_id, folded) group by all")
def keyed_multi(spark: SparkSession, sf: str) -> DataFrame:
    return I.keyed(_fields(spark, sf)).select("rec_id", "ord", "name", F.array_join("values", ",").alias("vals"))


@query("field_union_distinct", f"with {_FIELDS} select rec_id, ord, name, value from fields qualify row_number() over (partition by rec_id, lower(name), value order by ord) = 1")
def field_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return I.distinct_fields(_fields(spark, sf))
