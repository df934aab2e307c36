"""Queries over fields, edits, positions and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields as D
from ..operators import tags as G
from ..operators.signal import quantised
from ..registry import query
from ..views import table

c = F.col


@query("label_map", "select p_partkey, ['Title', 'Artist', 'Comment', 'Subject', 'Keywords', 'Date', 'Genre', 'Copyright', 'Engineer', 'Technician', 'Source', 'Product', 'Software', 'IXYZ', 'inam'][p_partkey % 15 + 1] label from part")
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    """RIFF INFO fields, one without a name, and one in another case."""
    key = F.element_at(F.array(*map(F.lit, (*G.INFO, "IXYZ", "inam"))), (c("p_partkey") % 15).cast("int") + 1)
    return table(spark, sf, "part").select("p_partkey", G.label(F.lit("info"), key).alias("label"))


@query("check_key", """select p_partkey, case k when 0 then p_size % 4 <> 3 when 1 then p_size % 4 in (0, 1) when 2 then p_size % 4 in (0, 1) when 3 then p_size % 4 in (0, 1) when 4 then p_size % 4 = 0 when 5 then p_size % 4 = 0 else false end allowed from (select *, p_partkey % 7 k from part)""")
def check_key(spark: SparkSession, sf: str) -> DataFrame:
    """Four keys for each of six kinds and an unknown one."""
    kinds = {
        "id3v2": ("TIT2", "TXXX:mood", "COMM", "TXXX"), "vorbis": ("TITLE", "a b}", "a=b", "caf\u00e9"), "ape": ("Record Date", "ab", "x", "\u00e9\u00e9"),
        "mp4": ("\u00a9nam", "----:com.x:y", "----:y", "abc"), "id3v1": ("Title", "title", "TIT2", ""), "guano": ("Loc Position", "a:b", "GUANO|Version", ""),
    }
    every = [*kinds.items(), ("none", ("a", "b", "c", "d"))]
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in every]), (c("p_partkey") % 7).cast("int") + 1)
    keys = F.element_at(F.array(*[F.array(*map(F.lit, x)) for _, x in every]), (c("p_partkey") % 7).cast("int") + 1)
    return table(spark, sf, "part").select("p_partkey", F.coalesce(G.key_allowed(kind, F.element_at(keys, c("p_size") % 4 + 1)), F.lit(False)).alias("allowed"))


@query("description", "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority when o_orderkey % 3 = 1 then o_orderstatus end as said from orders")
def description(spark: SparkSession, sf: str) -> DataFrame:
    note = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("sSPEED=1\n "), c("o_orderpriority"))).otherwise("zTRK1=x")
    comment = F.when(c("o_orderkey") % 3 < 2, c("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", D.description(note, comment).alias("said"))


@query("wall_start", "select o_orderkey, case when o_orderkey % 2 = 0 and o_custkey > 0 then round(o_custkey * 1000 / 48000.0, 3) else 77405 end::double as seconds, case when o_orderkey % 3 = 2 then strftime(o_orderdate, '%Y_%m_%d') else strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def wall_start(spark: SparkSession, sf: str) -> DataFrame:
    seconds, day = D.wall_start(F.when(c("o_orderkey") % 2 == 0, c("o_custkey") * 1000).otherwise(0), F.lit(48000), F.lit("21:30:05.5"), F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd")).when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", " yyyy/MM/dd ")).otherwise(F.date_format("o_orderdate", "yyyy_MM_dd")))
    return table(spark, sf, "orders").select("o_orderkey", F.round(seconds.cast("double"), 3).alias("seconds"), day.alias("day"))


@query("apply_tags", """with saved as (select o_orderkey // 4 rec_id, o_orderkey % 4 ord, o_orderstatus as name, o_orderpriority as value from orders), stored as (select rec_id, ord, name, case when rec_id % 5 = 0 and ord = 1 then 'other' else value end as value from saved),
 edited as (select rec_id, ord, name, case when ord = 2 then 'new' else value end as value from saved where ord <> 3), changed as (select distinct rec_id from stored s join saved v using (rec_id, ord) where s.value <> v.value)
 select rec_id, ord, name, value, false conflict from edited where rec_id not in (select rec_id from changed) union all select rec_id, ord, name, value, true from stored where rec_id in (select rec_id from changed)""")
def apply_tags(spark: SparkSession, sf: str) -> DataFrame:
    saved = table(spark, sf, "orders").select(F.floor(c("o_orderkey") / 4).alias("rec_id"), (c("o_orderkey") % 4).alias("ord"), c("o_orderstatus").alias("name"), c("o_orderpriority").alias("value"))
    stored = saved.withColumn("value", F.when((c("rec_id") % 5 == 0) & (c("ord") == 1), "other").otherwise(c("value")))
    edited = saved.where("ord <> 3").withColumn("value", F.when(c("ord") == 2, "new").otherwise(c("value")))
    return D.applied(stored, saved, edited)


@query("advance_wrap", "select l_orderkey, l_linenumber, l_partkey, case when p < 1000 then case when p + 700 >= 1000 then 3000 + p + 700 - 1000 else p + 700 end when p < 4000 then case when p + 700 >= 4000 then p + 700 - 4000 else p + 700 end else p + 700 end as moved from (select *, (l_partkey * 31) % 5000 p from lineitem)")
def advance_wrap(spark: SparkSession, sf: str) -> DataFrame:
    at = c("l_partkey") * 31 % 5000
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.advanced(at, F.lit(700), [(0, 1000), (3000, 4000)]).alias("moved"))


@query("timeline_place", """with recursive e as (select user_id k, event_id ord, event_id * 40 pos, floor(value * 4)::bigint f from events), n as (select *, row_number() over (partition by k order by ord, pos, f) i from e),
 t as (select k, i, ord, pos placed, 0::bigint skipped, pos + f expected from n where i = 1
 union all select n.k, n.i, n.ord, g.start, g.skip, g.start + n.f - g.skip from t join n on n.k = t.k and n.i = t.i + 1, lateral (select t.expected + case when n.pos - t.expected between 0 and 480 then n.pos - t.expected else 0 end as start, case when n.pos < t.expected then least(t.expected - n.pos, n.f) else 0 end skip) g)
 select k as key, ord, placed, skipped from t""")
def timeline_place(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(c("user_id").alias("rec_id"), c("event_id").alias("ord"), (c("event_id") * 40).alias("at"), F.floor(c("value") * 4).alias("frames"))
    return D.timeline(rows, 480)


@query("export_size", """select o_orderkey, greatest(least(greatest(ceil(n / 512)::bigint, least(n, 4096)), 16384, 64000000 // ("rows" * lanes)), 1)::bigint as "columns", "rows"
 from (select *, case when share > 0 then least(greatest(ceil(greatest(bins, 2048) / share)::bigint, least(greatest(bins, 2048), 8192)), 8192) else 2048 end "rows"
 from (select o_orderkey, (o_totalprice * 100)::bigint n, o_custkey * 7 % 9000 bins, o_orderkey % 5 / 4.0::double share, 1 + o_orderkey % 8 lanes from orders))""")
def export_size(spark: SparkSession, sf: str) -> DataFrame:
    columns, rows = D.picture_size(F.round(c("o_totalprice") * 100).cast("long"), 2048, c("o_custkey") * 7 % 9000, c("o_orderkey") % 5 / 4, 1 + c("o_orderkey") % 8)
    return table(spark, sf, "orders").select("o_orderkey", columns.alias("columns"), rows.alias("rows"))


@query("picture_distinct", "select user_id rec_id, min(event_id) ord from events group by user_id, event_type")
def picture_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(c("user_id").alias("rec_id"), c("event_id").alias("ord"), c("event_type").cast("binary").alias("content"))
    return D.distinct_pictures(rows).select("rec_id", "ord")


@query("checksums", """with t as (select list(list_reduce(range(8), lambda a, _: case when a & 128 > 0 then xor((a << 1) & 255, 7) else a << 1 end, i::bigint) order by i) s, list(list_reduce(range(8), lambda a, _: case when a & 32768 > 0 then xor((a << 1) & 65535, 32773) else a << 1 end, i::bigint << 8) order by i) l from range(256) r(i))
 select p_partkey as key, list_reduce(b, lambda a, x: s[xor(a, x) + 1], 0::bigint) crc8, list_reduce(b, lambda a, x: xor((a << 8) & 65535, l[xor(a >> 8, x) + 1]), 0::bigint) crc16 from (select p_partkey, list_transform(string_split(p_name, ''), lambda x: ord(x)::bigint) b from part), t""")
def checksums(spark: SparkSession, sf: str) -> DataFrame:
    return D.checksums(table(spark, sf, "part").select("p_partkey", c("p_name").cast("binary").alias("content")), "p_partkey", "content")
