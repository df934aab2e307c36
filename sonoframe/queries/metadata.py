"""Queries over metadata, WAV bytes and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..registry import query
from ..sources import recordings as R
from ..streaming import levels as L
from ..views import table

c = F.col


def _wavs(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as 16-bit WAV files: path, content."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [R.wav_bytes(np.floor(np.asarray(x, dtype=float) * 32768 + 0.5).clip(-32768, 32767).astype(int), 48000) for x in pdf.embedding]
            yield pd.DataFrame({"path": [f"{i}.wav" for i in pdf.vec_id], "content": made})

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(work, "path string, content binary")


@query("parse_wav", "select vec_id || '.wav' path, 'RIFF' container, 48000::bigint sample_rate, 1::bigint channels, 16::bigint bits, 64::bigint frames from embeddings")
def parse_wav(spark: SparkSession, sf: str) -> DataFrame:
    return R.headers(_wavs(spark, sf)).select("path", "container", "sample_rate", "channels", "bits", "frames")


@query("decode_pcm", "select vec_id || '.wav' path, (i - 1)::bigint frame, greatest(-32768, least(32767, floor(embedding[i]::double * 32768 + 0.5)))::bigint sample from (select vec_id, embedding, unnest(generate_series(1, 64)) i from embeddings)")
def decode_pcm(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.signal(_wavs(spark, sf), 48).select("path", "first_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select("path", (c("first_frame") + c("i")).alias("frame"), F.round(c("x") * 32768).cast("long").alias("sample"))


@query("key_values", "select event_id as key, 1::bigint ord, event_type as name, value::varchar || ':x' || chr(10) || 'y' as value from events union all select event_id, 3, 'Note', '' from events where event_id % 3 = 0")
def key_values(spark: SparkSession, sf: str) -> DataFrame:
    """A version line, a pair with a colon and an escape in its value, a line without a pair, and a third of the times an empty value."""
    note = F.when(c("event_id") % 3 == 0, "\r\nNote:").otherwise("")
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("GUANO|Version: 1.0\n "), "event_type", F.lit(" :  "), c("value").cast("string"), F.lit(":x\\ny\nno pair"), note).alias("text"))
    return M.key_values(rows, "event_id", "text")


@query("xml_leaves", "select o_orderkey as key, o::bigint ord, ['ORDER / STATUS', 'ORDER / LINE / PRIORITY', 'ORDER / DATE'][o + 1] path, [o_orderstatus, o_orderpriority || ' & more', strftime(o_orderdate, '%Y')][o + 1] as value from orders, (select unnest([0, 1, 2]) o)")
def xml_leaves(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(F.lit("<?xml?><ORDER a='1'><STATUS>"), "o_orderstatus", F.lit("</STATUS><!-- x --><LINE><PRIORITY>"), "o_orderpriority", F.lit(" &amp; more</LINE></STRAY><DATE><![CDATA["), F.date_format("o_orderdate", "yyyy"), F.lit("]]></DATE></ORDER>"))
    return M.xml_rows(table(spark, sf, "orders").select("o_orderkey", xml.alias("xml")), "o_orderkey", "xml")


@query("xml_numbered", "select o_orderkey as key, o::bigint ord, ['ORDER / STATUS', 'ORDER / LINE 1 / PRIORITY', 'ORDER / LINE 2 / PRIORITY', 'ORDER / LINE 3', 'ORDER / DATE'][o + 1] path, [o_orderstatus, o_orderpriority, '2 ' || o_orderpriority, 'x', strftime(o_orderdate, '%Y')][o + 1] as value from orders, (select unnest(generate_series(0, 4)) o)")
def xml_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Siblings of one name have numbers, an empty one too."""
    p = c("o_orderpriority")
    xml = F.concat(F.lit("<ORDER><STATUS>"), "o_orderstatus", F.lit("</STATUS><LINE><PRIORITY>"), p, F.lit("</PRIORITY></LINE><LINE><PRIORITY>2 "), p, F.lit("</LINE><LINE>x</LINE><DATE>"), F.date_format("o_orderdate", "yyyy"), F.lit("</DATE></ORDER>"))
    return M.xml_rows(table(spark, sf, "orders").select("o_orderkey", xml.alias("xml")), "o_orderkey", "xml", numbered=True)


@query("track_rows", """select o_orderkey as key, o::bigint ord, ['PROJECT', 'Track 1', 'Track 2', 'SPEED / NOTE'][o + 1] path, ['p ' || o_orderkey, o_orderpriority || case when o_orderkey % 2 = 0 then ', ' || o_orderstatus else '' end, 'M/S', 'n'][o + 1] as value
 from orders, (select unnest(generate_series(0, 3)) o)""")
def track_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks by their channel, with name and function, either of which may lack; other elements by their path."""
    function = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("<FUNCTION>"), "o_orderstatus", F.lit("</FUNCTION>"))).otherwise("")
    xml = F.concat(F.lit("<BWFXML><PROJECT>p "), c("o_orderkey").cast("string"), F.lit("</PROJECT><TRACK_LIST><TRACK_COUNT>2</TRACK_COUNT><TRACK><CHANNEL_INDEX>1</CHANNEL_INDEX><NAME>"), "o_orderpriority", F.lit("</NAME>"), function, F.lit("</TRACK><TRACK><CHANNEL_INDEX>2</CHANNEL_INDEX><NAME/><FUNCTION>M/S</FUNCTION></TRACK></TRACK_LIST><SPEED><NOTE>n</NOTE><EMPTY/></SPEED></BWFXML>"))
    return M.detail_rows(table(spark, sf, "orders").select("o_orderkey", xml.alias("xml")), "o_orderkey", "xml")


@query("chapter_markers", """select l_orderkey rec_id, l_linenumber::bigint id, round((60 * l_linenumber + l_partkey % 60 + 0.25) * 48000)::bigint frame, case when l_partkey % 3 = 0 then 0 when l_partkey % 3 = 1 then greatest(round(l_quantity * 48000)::bigint - 12000, 0) else 0 end::bigint length,
 case when l_partkey % 2 = 0 then l_returnflag else '' end label, l_linestatus note from (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) = 1)""")
def chapter_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chapters: some without a name or an end, some that end before they start."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf, "lineitem").withColumn("n", first).where("n = 1")
    key = F.format_string("CHAPTER%03d", c("l_linenumber"))
    clock = lambda s: F.concat_ws(":", F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.format_string("%06.3f", s % 60))
    start = 60 * c("l_linenumber") + c("l_partkey") % 60 + F.lit(0.25)
    stop = F.when(c("l_partkey") % 3 == 1, start + c("l_quantity") - 0.25).when(c("l_partkey") % 3 == 2, F.greatest(start - 20, F.lit(0.0)))
    parts = [(key, clock(start)), (F.lower(F.concat(key, F.lit("NAME"))), F.when(c("l_partkey") % 2 == 0, c("l_returnflag"))), (F.concat(key, F.lit("Note")), c("l_linestatus")), (F.concat(key, F.lit("END")), clock(stop))]
    fields = rows.select(c("l_orderkey").alias("rec_id"), F.explode(F.array(*[F.struct(k.alias("name"), v.alias("value")) for k, v in parts])).alias("x")).select("rec_id", "x.*").where("value is not null")
    return M.chapter_markers(fields, 48000)


@query("mark_bodies", """with m as (select c_custkey, vec_id, (c_custkey * 37 % 64)::bigint frame, case when c_custkey % 3 = 0 then c_custkey % 9 else 0 end::bigint length, case when c_custkey % 4 = 0 then null else c_mktsegment end label, case when c_custkey % 5 = 0 then c_name end note from customer join embeddings on vec_id = c_custkey % 700)
 select vec_id || '.wav' path, c_custkey::bigint id, frame, length, label, note, 'T' || vec_id title from m""")
def mark_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as markers of WAV files, and a title, written to bytes and read again."""
    from ..sources import patches as B

    marks = table(spark, sf, "customer").select((c("c_custkey") % 700).alias("vec_id"), F.struct(
        c("c_custkey").alias("id"), (c("c_custkey") * 37 % 64).alias("frame"), F.when(c("c_custkey") % 3 == 0, c("c_custkey") % 9).otherwise(0).alias("length"),
        F.when(c("c_custkey") % 4 > 0, c("c_mktsegment")).alias("label"), F.when(c("c_custkey") % 5 == 0, c("c_name")).alias("note")).alias("m"))
    marks = marks.groupBy("vec_id").agg(F.collect_list("m").alias("markers")).withColumn("path", F.concat(c("vec_id").cast("string"), F.lit(".wav")))
    info = F.array(F.struct(F.lit("INAM").alias("id"), F.concat(F.lit("T"), c("vec_id").cast("string")).alias("text")))
    rows = _wavs(spark, sf).join(marks, "path").select("path", "content", "markers", info.alias("info"))
    found = R.headers(B.patched(rows))
    return found.select("path", F.element_at("info", 1)["text"].alias("title"), F.explode("markers").alias("m")).select("path", "m.*", "title")


@query("chapters", "select o_orderkey rec_id, 1::bigint n, o_orderdate::date::varchar as start, o_orderpriority title, null::varchar note, case when o_orderkey % 2 = 0 then o_orderstatus end stop from orders")
def chapters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(c("o_orderkey").alias("rec_id"), F.explode(F.array(
        F.struct(F.lit("CHAPTER01").alias("name"), c("o_orderdate").cast("date").cast("string").alias("value")), F.struct(F.lit("chapter01name").alias("name"), c("o_orderpriority").alias("value")),
        F.struct(F.when(c("o_orderkey") % 2 == 0, "Chapter01End").otherwise("TITLE").alias("name"), c("o_orderstatus").alias("value")))).alias("x")).select("rec_id", "x.*")
    return M.chapters(rows)


@query("edit_diff", "select p_partkey, a was, b as now, case when a is null then 'added' when b is null then 'removed' else 'changed' end what from (select p_partkey, case when p_partkey % 3 > 0 then p_name end a, case when p_partkey % 4 > 0 then case when p_partkey % 5 = 0 then upper(p_name) else p_name end end b from part) where a is distinct from b")
def edit_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    after = rows.where("p_partkey % 4 > 0").select("p_partkey", F.when(c("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(c("p_name")).alias("p_name"))
    return M.difference(rows.where("p_partkey % 3 > 0"), after, ["p_partkey"], "p_name")


@query("sync_points", "select l_orderkey, l_linenumber, l_partkey, (l_linenumber::bigint << 32) | l_partkey frame from lineitem")
def sync_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.sync_point(c("l_linenumber"), c("l_partkey")).alias("frame"))


@query("level_windows", "select user_id, time_bucket(interval 1 hour, ts) as start, round(max(abs(value)) * 1e6)::bigint peak, count(*)::bigint n from events group by all")
def level_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", c("ts").cast("timestamp").alias("ts"), c("value").alias("x"))
    return L.level_windows(rows, "1 hour", "1 hour").select("user_id", c("start").cast("timestamp_ntz").alias("start"), F.round(c("peak") * 1e6).cast("long").alias("peak"), "n")


@query("peak_hold", """with recursive e as (select user_id as key, epoch_us(ts) / 6e8 t, value / 4 - 100 as level from events), n as (select *, row_number() over (partition by key order by t, level) i from e),
 h as (select key, i, t, greatest(level, -100) shown, case when level >= -100 then t else 'infinity'::double end since from n where i = 1
 union all select n.key, n.i, n.t, case when n.level >= h.shown then n.level when n.t - h.since > 1.5 then greatest(h.shown - 15 * greatest(n.t - h.t, 0), -100) else h.shown end, case when n.level >= h.shown then n.t else h.since end from h join n on n.key = h.key and n.i = h.i + 1)
 select key, round(t * 1e6)::bigint as at, round(shown * 1e6)::bigint shown from h""")
def peak_hold(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_micros(c("ts").cast("timestamp")) / 6e8
    rows = L.peak_hold_batch(table(spark, sf, "events").select("user_id", at.alias("at"), (c("value") / 4 - 100).alias("level")))
    return rows.select("key", F.round(c("at") * 1e6).cast("long").alias("at"), F.round(c("shown") * 1e6).cast("long").alias("shown"))
