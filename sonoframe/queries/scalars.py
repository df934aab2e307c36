"""Queries that apply the scalar rules to columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..registry import query
from ..views import FILES, files, table

c = F.col


def _e(x, scale: float = 1e6):
    """A double as a rounded whole number, so that both engines' last bits don't matter."""
    return F.round(x * scale).cast("long")


@query("parse_length", """select o_orderkey, txt, case o_orderkey % 7 when 0 then k when 1 then k // 60 * 60.0 + k % 60 when 2 then 60.0 * k when 3 then 3600 * (k + 0.5) when 4 then k when 5 then 60.0 * k + 30.5 end::double as seconds
 from (select o_orderkey, k, case o_orderkey % 7 when 0 then k::varchar when 1 then (k // 60) || ':' || lpad((k % 60)::varchar, 2, '0') when 2 then k || ' m' when 3 then k || ',5 h' when 4 then k || 's' when 5 then k || ':30.5' else k || ' hours' end txt from (select o_orderkey, (o_orderkey % 300)::bigint k from orders))""")
def parse_length(spark: SparkSession, sf: str) -> DataFrame:
    n = c("o_orderkey") % 300
    k = n.cast("string")
    forms = (k, F.concat(F.floor(n / 60).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0")), F.concat(k, F.lit(" m")), F.concat(k, F.lit(",5 h")), F.concat(k, F.lit("s")), F.concat(k, F.lit(":30.5")), F.concat(k, F.lit(" hours")))
    return table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*forms), (c("o_orderkey") % 7).cast("int") + 1).alias("txt")).withColumn("seconds", T.parse_length(c("txt")))


@query("parse_hz", "select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then 1000.0 * p_size when 2 then 1000 * (p_size + 0.5) end::double hz from part")
def parse_hz(spark: SparkSession, sf: str) -> DataFrame:
    s = c("p_size").cast("string")
    txt = F.when(c("p_partkey") % 4 == 0, F.concat(s, F.lit(" Hz"))).when(c("p_partkey") % 4 == 1, F.concat(s, F.lit("k"))).when(c("p_partkey") % 4 == 2, F.concat(s, F.lit(",5 kHz"))).otherwise("-3")
    return table(spark, sf, "part").select("p_partkey", T.parse_hz(txt).alias("hz"))


_HZ = """case when hz < 1000 then round_even(hz, 0)::bigint::varchar when hz >= 1000000 then regexp_replace(round_even(hz / 1000000, 2)::decimal(18,2)::varchar, '[.]?0+$', '') || 'M'
 when abs(hz / 1000 - round(hz / 1000)) < 0.05 then round_even(hz / 1000, 0)::bigint || 'k' else round_even(hz / 1000, 1)::decimal(18,1) || 'k' end"""


@query("hz_text", f"""select l_orderkey, l_linenumber, {_HZ} as label,
 case when hz >= 1000000 then regexp_replace(round_even(hz / 1000000, 3)::decimal(18,3)::varchar, '[.]?0+$', '') || ' MHz' when hz >= 10000 then round_even(hz / 1000, 1)::decimal(18,1) || ' kHz' when hz >= 1000 then round_even(hz / 1000, 2)::decimal(18,2) || ' kHz' else round_even(hz, 0)::bigint || ' Hz' end field,
 case when hz >= 10000 then round_even(hz / 1000, 2)::decimal(18,2) || ' kHz' when hz >= 1000 then round_even(hz / 1000, 3)::decimal(18,3) || ' kHz' else round_even(hz, 1)::decimal(18,1) || ' Hz' end exact
 from (select *, (l_partkey * case l_linenumber % 3 when 0 then 0.5 when 1 then 37.0 else 4321.0 end)::double hz from lineitem)""")
def hz_text(spark: SparkSession, sf: str) -> DataFrame:
    hz = c("l_partkey") * F.when(c("l_linenumber") % 3 == 0, 0.5).when(c("l_linenumber") % 3 == 1, 37.0).otherwise(4321.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.hz_text(hz).alias("label"), N.hz_field(hz).alias("field"), N.hz_exact(hz).alias("exact"))


@query("parse_speed", "select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then 1 / p_size::double when 2 then p_size end::double speed from part")
def parse_speed(spark: SparkSession, sf: str) -> DataFrame:
    s, k = c("p_size").cast("string"), c("p_partkey") % 4
    txt = F.when(k == 0, F.concat(s, F.lit("x"))).when(k == 1, F.concat(F.lit(" 1 / "), s)).when(k == 2, F.concat(F.lit("× "), s, F.lit(" ×"))).when(c("p_partkey") % 8 == 3, "1/0").otherwise("fast")
    return table(spark, sf, "part").select("p_partkey", N.parse_speed(txt).alias("speed"))


@query("speed_text", """select p_partkey, case when v < 1 and abs(1 / v - round(1 / v)) < 1e-6 then '1/' || round(1 / v)::bigint || '×'
 else regexp_replace(regexp_replace(round_even(v, greatest(3 - floor(log10(v)), 0)::int)::decimal(18, 8)::varchar, '0+$', ''), '[.]$', '') || '×' end label
 from (select p_partkey, case p_partkey % 3 when 0 then 1 / p_size::double when 1 then p_size * 1.23457::double else p_size / 7.0::double end v from part)""")
def speed_text(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey") % 3
    v = F.when(k == 0, 1 / c("p_size")).when(k == 1, c("p_size") * 1.23457).otherwise(c("p_size") / 7)
    return table(spark, sf, "part").select("p_partkey", N.speed_text(v).alias("label"))


@query("clock", """select event_id, case when a >= 3600 then (a // 3600) || ':' || lpad((a // 60 % 60)::varchar, 2, '0') else (a // 60)::varchar end || ':' || lpad((a % 60)::varchar, 2, '0') elapsed,
 case when b >= 360000 then (b // 360000) || ':' || lpad((b // 6000 % 60)::varchar, 2, '0') else (b // 6000)::varchar end || ':' || lpad((b // 100 % 60)::varchar, 2, '0') || '.' || lpad((b % 100)::varchar, 2, '0') fine
 from (select event_id, round(greatest(value * 50 - 100, 0))::bigint a, round(greatest(value * 50 - 100, 0) * 100)::bigint b from events)""")
def clock(spark: SparkSession, sf: str) -> DataFrame:
    x = c("value") * 50 - 100
    return table(spark, sf, "events").select("event_id", N.clock(x).alias("elapsed"), N.clock(x, 2).alias("fine"))


@query("wall", """select event_id, strftime(timestamp '2024-01-01' + to_seconds(round(m)::bigint), '%H:%M:%S') at_time, strftime(timestamp '2024-01-01' + to_milliseconds(round(m * 1000)::bigint), '%H:%M:%S.%g') fine
 from (select event_id, x - 86400 * floor(x / 86400) m from (select event_id, case when event_id % 50 = 0 then -0.0001 else value * 500 - 40000 end x from events))""")
def wall(spark: SparkSession, sf: str) -> DataFrame:
    """Also before midnight, and what rounds up to it."""
    x = F.when(c("event_id") % 50 == 0, -0.0001).otherwise(c("value") * 500 - 40000)
    return table(spark, sf, "events").select("event_id", N.wall(x).alias("at_time"), N.wall(x, 3).alias("fine"))


@query("time_of_day", """select l_orderkey, l_linenumber, lpad((ms // 3600000)::varchar, 2, '0') || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0') shown,
 case when l_linenumber % 5 = 0 then null when l_linenumber % 5 = 1 then 0 else ms * 48 end::bigint back, case when l_linenumber % 5 = 0 then 'Start 24:00:' || l_partkey % 60 || ' is not a time of day like 13:45:10.250' end problem
 from (select *, floor(l_extendedprice * 100000)::bigint * 1000 // 48000 % 86400000 ms from lineitem)""")
def time_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of samples, some past midnight, as times, and those read again; a fifth of the times is none, a fifth blank."""
    shown, k = N.sample_time(F.floor(c("l_extendedprice") * 100000), F.lit(48000)), c("l_linenumber") % 5
    typed = F.when(k == 0, F.concat(F.lit("24:00:"), (c("l_partkey") % 60).cast("string"))).when(k == 1, "  ").otherwise(F.concat(F.lit(" "), shown))
    back, problem = N.time_samples(typed, F.lit(48000))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"), back.alias("back"), problem.alias("problem"))


@query("clock_seconds", "select event_id, case when event_id % 5 < 4 then hour(ts) * 3600 + minute(ts) * 60 + second(ts) end as seconds from events")
def clock_seconds(spark: SparkSession, sf: str) -> DataFrame:
    k, of = c("event_id") % 5, lambda p: F.date_format("ts", p)
    form = F.when(k == 0, of("HH:mm:ss")).when(k == 1, of("HH-mm.ss")).when(k == 2, F.concat(of("HH:mm:ss"), F.lit(".5"))).when(k == 3, of(" H : m : s ")).when(c("event_id") % 2 == 0, "25:61:99").otherwise(of("HH:mm"))
    return table(spark, sf, "events").select("event_id", N.clock_seconds(form).alias("seconds"))


@query("db", "select event_id, case when x > 0 then round(greatest(20 * log10(x / 400), -100) * 1e6) else -100e6 end::bigint amplitude, case when x > 0 then round(greatest(10 * log10(x), -200) * 1e6) else -200e6 end::bigint as power from (select event_id, case when event_id % 7 = 0 then 0 when event_id % 7 = 1 then value * 1e-25 else value end x from events)")
def db(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(c("event_id") % 7 == 0, 0.0).when(c("event_id") % 7 == 1, c("value") * 1e-25).otherwise(c("value"))
    return table(spark, sf, "events").select("event_id", _e(N.amplitude_db(x / 400)).alias("amplitude"), _e(N.power_db(x)).alias("power"))


@query("lift_gain", "select event_id, round(case when x > -100 then greatest(x + g, -100) else -100 end * 1e6)::bigint as level from (select event_id, value / 2 - 150 x, case when event_id % 2 = 0 then 6 else -20 end g from events)")
def lift_gain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", _e(N.lifted(c("value") / 2 - 150, F.when(c("event_id") % 2 == 0, 6.0).otherwise(-20.0))).alias("level"))


@query("frequency_axis", "select p_partkey, round((p_retailprice - 20) / 19980 * 1e6)::bigint as linear, round(ln(p_retailprice / 20) / ln(1000) * 1e6)::bigint as logarithmic, round(20 * pow(1000, (p_retailprice - 20) / 19980) * 1e6)::bigint back from part")
def frequency_axis(spark: SparkSession, sf: str) -> DataFrame:
    hz = c("p_retailprice")
    place = N.frequency_place(hz, 20.0, 20000.0, False)
    return table(spark, sf, "part").select("p_partkey", _e(place).alias("linear"), _e(N.frequency_place(hz, 20.0, 20000.0, True)).alias("logarithmic"), _e(N.frequency_at(place, 20.0, 20000.0, True)).alias("back"))


@query("gain_linear", "select event_id, round(pow(10, (value / 10 - 20) / 20) * 1e6)::bigint gain, round(pow(2, (value / 10 - 20) / 12) * 1e6)::bigint pitch, round(greatest(0, least(1, (value / 10 - 20 + 60) / 60)) * 1e6)::bigint meter from events")
def gain_linear(spark: SparkSession, sf: str) -> DataFrame:
    x = c("value") / 10 - 20
    return table(spark, sf, "events").select("event_id", _e(N.gain(x)).alias("gain"), _e(N.hz_scale(x)).alias("pitch"), _e(N.meter_position(x)).alias("meter"))


@query("ns_timestamp", "select o_orderkey, ((o_orderkey::hugeint * 7919 * 1000000000 + 44099) // 44100)::bigint ns, (o_orderkey::hugeint * 7919 * 48000 // 44100)::bigint as rescaled from orders")
def ns_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    frame = c("o_orderkey") * 7919
    return table(spark, sf, "orders").select("o_orderkey", N.nanoseconds(frame, F.lit(44100)).alias("ns"), N.rescaled(frame, F.lit(44100), F.lit(48000)).alias("rescaled"))


@query("legal_rates", """with recursive r as (select p_partkey, (p_size * case when p_partkey % 3 = 0 then 11025 else 12345 end)::bigint rate from part), h as (select p_partkey, rate from r union all select p_partkey, rate // 2 from h where rate > 200000)
 select r.p_partkey, case when r.rate > 48000 and r.rate % 11025 = 0 then 44100 else coalesce(list_min(list_filter([8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000], lambda x: x >= r.rate)), 48000) end::bigint mp3, min(h.rate)::bigint vorbis, regexp_replace((r.rate / 1000)::decimal(12,3)::varchar, '[.]?0+$', '') || ' kHz' label from r join h using (p_partkey) group by all""")
def legal_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = (c("p_size") * F.when(c("p_partkey") % 3 == 0, 11025).otherwise(12345)).cast("long")
    return table(spark, sf, "part").select("p_partkey", N.mp3_rate(rate).cast("long").alias("mp3"), N.vorbis_rate(rate).alias("vorbis"), N.khz_text(rate).alias("label"))


@query("split_ext", f"with {FILES} select rec_id, regexp_extract(name, '^(.+)[.]([^.]*)$', 1) stem, regexp_extract(name, '^(.+)[.]([^.]*)$', 2) ext from files")
def split_ext(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("rec_id", T.stem(c("name")).alias("stem"), T.extension(c("name")).alias("ext"))


@query("numerals", """select p_partkey, case when k = 0 then '' when k <= 26 then chr(96 + k::int) else chr((96 + (k - 1) // 26)::int) || chr((97 + (k - 1) % 26)::int) end letters,
 case when k = 0 then '' else repeat('C', (k // 100)::int) || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][k // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][k % 10 + 1] end roman,
 case when p_partkey % 2 = 1 then '-' else '' end || case when k < 100 then lpad(k::varchar, 3, '0') else k::varchar end padded,
 case when p_partkey % 2 = 1 and k > 0 then '-' || lpad(k::varchar, greatest(4, length(k::varchar))::int, '0') else lpad(k::varchar, greatest(5, length(k::varchar))::int, '0') end signed from (select p_partkey, p_partkey % 300 k from part)""")
def numerals(spark: SparkSession, sf: str) -> DataFrame:
    k = c("p_partkey") % 300
    minus = F.when(c("p_partkey") % 2 == 1, -k).otherwise(k)
    sign = F.when((k == 0) & (c("p_partkey") % 2 == 1), "-").otherwise("")
    return table(spark, sf, "part").select("p_partkey", T.letters(k).alias("letters"), T.roman(k).alias("roman"), F.concat(sign, T.padded(minus, 3)).alias("padded"), T.sign_padded(minus, 5).alias("signed"))


@query("title_words", "select p_partkey, array_to_string(list_transform(regexp_extract_all(upper(p_name) || ' o''neil-' || p_type, '[A-Za-z0-9'']+|[^A-Za-z0-9'']+'), lambda x: upper(x[1]) || lower(x[2:])), '') title from part")
def title_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.title_words(F.concat(F.upper("p_name"), F.lit(" o'neil-"), "p_type")).alias("title"))


@query("insert_text", "select p_partkey, left(p_name, least(p_size, length(p_name) + 1) - 1) || '-' || substr(p_name, least(p_size, length(p_name) + 1)) put, case when p_size % 2 = 0 then p_name || '_' || p_brand else p_name end beside from part")
def insert_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.inserted(c("p_name"), F.lit("-"), c("p_size")).alias("put"), T.beside(c("p_name"), F.when(c("p_size") % 2 == 0, c("p_brand")).otherwise(""), "_").alias("beside"))


@query("valid_name", "select p_partkey, case p_partkey % 8 when 0 then 'empty' when 1 then 'edge space' when 2 then 'leading dot' when 3 then 'reserved' when 4 then case when strlen(p_name) * 30 > 255 then 'too long' end when 5 then 'edge space' when 6 then 'reserved' end problem from part")
def valid_name(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks and control characters beyond ASCII count too."""
    k, n = c("p_partkey") % 8, c("p_name")
    name = F.when(k == 0, " \u2003").when(k == 1, F.concat(n, F.lit(" "))).when(k == 2, F.concat(F.lit("."), n)).when(k == 3, F.concat(n, F.lit(":x"))).when(k == 4, F.repeat(F.replace(n, F.lit(" "), F.lit("_")), F.lit(30))).when(k == 5, F.concat(F.lit("\u00a0"), n)).when(k == 6, F.concat(n, F.lit("\u0085x"))).otherwise(n)
    return table(spark, sf, "part").select("p_partkey", T.name_problem(name).alias("problem"))


@query("size_text", "select o_orderkey, case when b >= 100000000 then round_even(b / 1000000.0::double, 0)::bigint || ' MB' else round_even(b / 1000000.0::double, 1)::decimal(20,1) || ' MB' end as shown from (select o_orderkey, floor(o_totalprice)::bigint * 1000 // 100000 * 100000 b from orders)")
def size_text(spark: SparkSession, sf: str) -> DataFrame:
    b = F.expr("floor(o_totalprice) * 1000 div 100000 * 100000")
    return table(spark, sf, "orders").select("o_orderkey", N.size_text(b).alias("shown"))


@query("chapter_key", "select o_orderkey, case when o_orderkey % 4 < 3 then o_orderkey % 100 end::bigint n, case o_orderkey % 4 when 0 then '' when 1 then 'NAME' when 2 then 'END' end part from orders")
def chapter_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.lpad((c("o_orderkey") % 100).cast("string"), 3, "0")
    key = F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("CHAPTER"), k)).when(c("o_orderkey") % 4 == 1, F.concat(F.lit("chapter"), k, F.lit("name"))).when(c("o_orderkey") % 4 == 2, F.concat(F.lit("Chapter"), k, F.lit("End"))).otherwise("TITLE")
    n, part = T.chapter_key(key)
    return table(spark, sf, "orders").select("o_orderkey", n.alias("n"), part.alias("part"))


@query("comment_key", "select doc_id, case when text = '' then '_' else regexp_replace(text, '[^ -<>-}]', '_', 'g') end as key from documents")
def comment_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.comment_key(c("text")).alias("key"))


@query("number_split", """select p_partkey, case p_partkey % 5 when 0 then p_size::varchar when 1 then p_size::varchar when 2 then 'AC/' || p_size when 3 then p_size || '/' else p_size || '/2/3' end number, case when p_partkey % 5 = 0 then (p_size + 3)::varchar end total from part""")
def number_split(spark: SparkSession, sf: str) -> DataFrame:
    s, k = c("p_size").cast("string"), c("p_partkey") % 5
    txt = F.when(k == 0, F.concat(F.lit(" "), s, F.lit(" / "), (c("p_size") + 3).cast("string"))).when(k == 1, s).when(k == 2, F.concat(F.lit("AC/"), s)).when(k == 3, F.concat(s, F.lit("/"))).otherwise(F.concat(s, F.lit("/2/3")))
    n, total = T.number_split(txt)
    return table(spark, sf, "part").select("p_partkey", n.alias("number"), total.alias("total"))


@query("nice_step", "select o_orderkey, round(p * case when x <= 1.000000001 then 1 when x <= 2.000000002 then 2 when x <= 2.5000000025 then 2.5 when x <= 5.000000005 then 5 else 10 end * 1e6)::bigint step from (select o_orderkey, pow(10, floor(log10(o_totalprice / 12))) p, o_totalprice / 12 / p x from orders)")
def nice_step(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", _e(N.nice_step(c("o_totalprice"), F.lit(12))).alias("step"))


@query("animal_change", "select p_partkey, round(greatest(0, least(1, case when hz > 20000 then ln(hz / 20000) / ln(5) when hz < 20 then log2(20 / hz) else 0 end)) * 1e6)::bigint change from (select p_partkey, case when p_partkey % 2 = 0 then p_size * 2500.0 else p_size::double end hz from part)")
def animal_change(spark: SparkSession, sf: str) -> DataFrame:
    hz = F.when(c("p_partkey") % 2 == 0, c("p_size") * 2500.0).otherwise(c("p_size").cast("double"))
    return table(spark, sf, "part").select("p_partkey", _e(N.animal_change(hz)).alias("change"))


@query("nearest_bin", "select o_orderkey, case when hz <= 24000 then least(round(hz / 23.4375), 1024)::bigint end bin from (select o_orderkey, case when o_orderkey % 9 = 0 then 23990 + o_orderkey % 25 else o_totalprice / 10 end hz from orders)")
def nearest_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Some are just under what the file holds, at it and just past it."""
    hz = F.when(c("o_orderkey") % 9 == 0, 23990 + c("o_orderkey") % 25).otherwise(c("o_totalprice") / 10)
    return table(spark, sf, "orders").select("o_orderkey", N.nearest_bin(hz, F.lit(23.4375), 1025).alias("bin"))


@query("pack_position", "select l_orderkey, l_linenumber, ((s::hugeint << 48) + l_partkey - case when s >= 32768 then 18446744073709551616::hugeint else 0 end)::bigint packed, s::bigint seek, l_partkey frame from (select *, l_linenumber * 9001 % 65536 s from lineitem)")
def pack_position(spark: SparkSession, sf: str) -> DataFrame:
    packed = N.packed(c("l_linenumber") * 9001, c("l_partkey"))
    seek, frame = N.unpacked(packed)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", packed.alias("packed"), seek.alias("seek"), frame.alias("frame"))


@query("clamp_view", "select l_orderkey, l_linenumber, greatest(0, least(s, 10000 - n))::bigint as start, n::bigint as length from (select l_orderkey, l_linenumber, l_partkey * 40 - 500 s, least(greatest((l_quantity * 3)::bigint, 64), 10000) n from lineitem)")
def clamp_view(spark: SparkSession, sf: str) -> DataFrame:
    start, length = N.view(c("l_partkey") * 40 - 500, (c("l_quantity") * 3).cast("long"), F.lit(10000).cast("long"), 48000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), length.alias("length"))


@query("summary", "select p_partkey, array_to_string(list_filter([p_brand, case when p_size % 2 = 0 then p_type end, p_size || ' s'], lambda x: x is not null), ' · ') line from part")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" · ", "p_brand", F.when(c("p_size") % 2 == 0, c("p_type")), F.concat(c("p_size").cast("string"), F.lit(" s"))).alias("line"))


@query("recorder_date", "select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') || ' 21:30:00' when 1 then year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || ' 21:30' when 2 then '24-13-' || o_orderstatus || ' 9' end as found from orders")
def recorder_date(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of two and of few digits, one that is none, and other comments."""
    k, of = c("o_orderkey") % 4, lambda p: F.date_format("o_orderdate", p)
    comment = F.when(k == 0, F.concat(F.lit("Recorded at 21:30:00 "), of("dd/MM/yyyy"), F.lit(" (UTC+1) by a recorder. Recorded at 1 2/3/4"))).when(k == 1, F.concat(F.lit("It was Recorded at 21:30\t"), of("d/M/yyyy"), F.lit("/x")))
    comment = comment.when(k == 2, F.concat(F.lit("Recorded at 9 "), "o_orderstatus", F.lit("/13/24"))).otherwise("Recorded at dusk")
    return table(spark, sf, "orders").select("o_orderkey", T.recorder_date(comment).alias("found"))


@query("speed_limits", "select p_partkey, round(4.8 / p_size * 1e9)::bigint slowest, round(1e7 / p_size * 1e3)::bigint fastest from part")
def speed_limits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", _e(4.8 / c("p_size"), 1e9).alias("slowest"), _e(1e7 / c("p_size"), 1e3).alias("fastest"))


@query("level_text", "select event_id, case when x <= -100 then '-∞' else printf('%.1f', x) end as level from (select event_id, event_id % 130 - 110 + event_id % 7 / 7.0::double x from events)")
def level_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", N.level_text(c("event_id") % 130 - 110 + c("event_id") % 7 / 7.0).alias("level"))


@query("time_ticks", """select o_orderkey, coalesce((select min(s) from (select unnest([0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400]::double[]) s) where seconds / s <= fits), 28800)::double step
 from (select o_orderkey, o_totalprice * o_totalprice / 5000 as seconds, greatest((o_orderkey % 1300) / 90, 1) fits from orders)""")
def time_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", N.time_step(c("o_totalprice") * c("o_totalprice") / 5000, c("o_orderkey") % 1300).alias("step"))


@query("frequency_ticks", """with t as (select p_partkey, case when len(a) * 16 > p_partkey % 40 * 10 + 40 then list_filter(a, lambda f: log10(f) = floor(log10(f))) else a end t from (select p_partkey, list_filter(flatten(list_transform(range(0, 6),
 lambda d: [pow(10.0, d), 2 * pow(10.0, d), 5 * pow(10.0, d)])), lambda f: f >= p_size and f <= p_retailprice * 10) a from part))
 select p_partkey, array_to_string(list_transform(t, lambda f: round(f)::bigint), ' ') ticks from t""")
def frequency_ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = N.log_ticks(c("p_size").cast("double"), c("p_retailprice") * 10, c("p_partkey") % 40 * 10 + 40, F.lit(16))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(ticks, lambda f: F.round(f).cast("long")), " ").alias("ticks"))


@query("zoom_view", """with v as (select l_orderkey, l_linenumber, (l_quantity * 100)::double s, (l_partkey % 4000 + 100)::double n, case l_linenumber % 3 when 0 then 0.5 when 1 then 2 else 0.001 end f, (l_quantity * 100 + l_suppkey)::double a from lineitem),
 z as (select *, least(greatest(n * f, 64), 10000) m from v) select l_orderkey, l_linenumber, round(greatest(0, least(a - (a - s) / n * (n * f), 10000 - m)) * 1e3)::bigint as start, round(m * 1e3)::bigint as length,
 round(case when a > s + 0.9 * n and s + n < 10000 or a < s then greatest(0, least(a - 0.1 * n, 10000 - least(greatest(n, 64), 10000))) else s end * 1e3)::bigint page from z""")
def zoom_view(spark: SparkSession, sf: str) -> DataFrame:
    """Views zoomed around an anchor, and paged by a playhead there."""
    s, n, a = (c("l_quantity") * 100).cast("double"), (c("l_partkey") % 4000 + 100).cast("double"), (c("l_quantity") * 100 + c("l_suppkey")).cast("double")
    f = F.when(c("l_linenumber") % 3 == 0, 0.5).when(c("l_linenumber") % 3 == 1, 2.0).otherwise(0.001)
    start, length = N.zoomed(s, n, a, f, F.lit(10000.0), 48000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _e(start, 1e3).alias("start"), _e(length, 1e3).alias("length"), _e(N.paged(s, n, a, F.lit(10000.0), 48000), 1e3).alias("page"))


@query("band_limits", """with b as (select p_partkey, p_size * 1000.0::double lo, p_retailprice * 37.0::double hi, case p_partkey % 3 when 0 then 8000 when 1 then 48000 else 4000000 end::double rate from part), t as (select *, rate / 2048 bin, greatest(least(hi, greatest(1e6, rate / 2)), rate / 2048 * 2) top from b),
 l as (select *, least(greatest(lo, bin), top - bin) low from t) select p_partkey, round(low * 1e3)::bigint low, round(top * 1e3)::bigint high, round(case when low < rate / 2 then low end * 1e3)::bigint held_low, round(case when low < rate / 2 then least(top, rate / 2) end * 1e3)::bigint held_high from l""")
def band_limits(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = c("p_size") * 1000.0, c("p_retailprice") * 37.0
    rate = F.when(c("p_partkey") % 3 == 0, 8000.0).when(c("p_partkey") % 3 == 1, 48000.0).otherwise(4000000.0)
    low, high = N.band(lo, hi, rate, 2048, True)
    held_low, held_high = N.held_band(lo, hi, rate, 2048, True)
    return table(spark, sf, "part").select("p_partkey", _e(low, 1e3).alias("low"), _e(high, 1e3).alias("high"), _e(held_low, 1e3).alias("held_low"), _e(held_high, 1e3).alias("held_high"))


@query("sane_settings", """select p_partkey, case when p_partkey % 7 = 0 then 0 else greatest(-20, least(80, v)) end brightness, case when p_partkey % 7 = 0 then 90 else greatest(20, least(160, v)) end contrast, case when p_partkey % 7 = 0 then 0 else round(greatest(-48, least(48, v / 3))) end pitch,
 case when f in (512, 1024, 2048, 4096, 8192) then f else 2048 end::int fft, case when s in (1, 2, 4, 8) then s else 1 end::double speed, case when s in (0.1, 0.125, 0.25, 0.5, 1, 2, 4, 8) then s else 1 end::double slow_speed, case when v > 0 then least(v * 20000, 1e6) end band_high
 from (select p_partkey, (p_retailprice - 1000)::double v, 256 << (p_partkey % 8)::int f, [0.1, 0.125, 0.5, 1, 2, 3, 8, 16][p_partkey % 8 + 1]::double s from part)""")
def sane_settings(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(c("p_partkey") % 7 == 0, F.when(c("p_partkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(None).cast("double"))).otherwise(c("p_retailprice") - 1000)
    f = F.expr("shiftleft(256L, cast(p_partkey % 8 as int))")
    s = F.element_at(F.array(*map(F.lit, (0.1, 0.125, 0.5, 1.0, 2.0, 3.0, 8.0, 16.0))), (c("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", N.setting("brightness", v).alias("brightness"), N.setting("contrast", v).alias("contrast"), N.setting("pitch", v / 3).alias("pitch"), N.fft_setting(f).cast("int").alias("fft"),
        N.speed_setting(s, False).alias("speed"), N.speed_setting(s, True).alias("slow_speed"), N.band_high_setting((c("p_retailprice") - 1000) * 20000).alias("band_high"),
    )
