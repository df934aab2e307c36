"""Queries of markers, drawn regions, track names and progress on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import markers as M
from ..registry import query
from ..views import INTERVALS, intervals, table

c = F.col


@query("marker_from_selection", f"with {INTERVALS} select rec_id, ord, case when ord % 3 > 0 then lo else case when ord % 2 = 0 then hi else 0 end end as frame, case when ord % 3 > 0 then hi - lo else 0 end as length from intervals")
def marker_from_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = c("ord") % 3 > 0
    frame, length = M.marker_from_selection(F.when(chosen, c("lo")), F.when(chosen, c("hi")), F.when(c("ord") % 2 == 0, c("hi")))
    return intervals(spark, sf).select("rec_id", "ord", frame.alias("frame"), length.alias("length"))


@query("marker_order", f"with {INTERVALS} select rec_id, ord as id, lo as frame, row_number() over (partition by rec_id order by lo, ord) as place from intervals")
def marker_order(spark: SparkSession, sf: str) -> DataFrame:
    return M.marker_order(intervals(spark, sf).select("rec_id", c("ord").alias("id"), c("lo").alias("frame")))


@query("region_normalise", f"with {INTERVALS} select rec_id, ord, lo as first, hi as last, case when ord % 4 = 0 then 0 else least(lo_hz, 8000) end::double as low, case when ord % 4 = 0 then 8000 else least(hi_hz, 8000) end::double as high from intervals")
def region_normalise(spark: SparkSession, sf: str) -> DataFrame:
    turned = c("ord") % 2 == 0
    x0, x1 = F.when(turned, c("hi")).otherwise(c("lo")), F.when(turned, c("lo")).otherwise(c("hi"))
    y0, y1 = F.when(turned, c("lo_hz")).otherwise(c("hi_hz")).cast("double"), F.when(turned, c("hi_hz")).otherwise(c("lo_hz")).cast("double")
    columns = M.drawn_region(x0, y0, x1, y1, F.lit(8000.0), c("ord") % 4 == 0)
    return intervals(spark, sf).select("rec_id", "ord", *[x.alias(name) for x, name in zip(columns, ("first", "last", "low", "high"))])


@query("shown_floor", "select p_partkey, -((p_size - 25) + (p_partkey % 90 + 30))::double as floor_db from part")
def shown_floor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", M.shown_floor((c("p_size") - 25).cast("double"), (c("p_partkey") % 90 + 30).cast("double")).alias("floor_db"))


@query("meter_position", "select event_id, greatest(0.0, least(1.0, (10 - value + 60) / 60))::double as position from events")
def meter_position(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", N.meter_position(10 - c("value")).alias("position"))


@query("hz_scale", "select p_partkey, round(pow(2.0, (p_size - 25) / 12.0) * 1e6)::bigint as scale_millionths from part")
def hz_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(N.hz_scale((c("p_size") - 25).cast("double")) * 1e6).cast("long").alias("scale_millionths"))


@query("track_names", """with t as (select l_orderkey rec_id, l_linenumber ord, l_partkey % 4 i, case when l_partkey % 5 > 0 then l_shipdate::date::varchar else ' ' end n from lineitem),
 last as (select rec_id, i - 1 channel, last(trim(n) order by ord, trim(n)) track_name from t where trim(n) <> '' group by all),
 ch as (select o_orderkey rec_id, unnest([0, 1, 2])::bigint channel from orders)
 select ch.rec_id, ch.channel, track_name from ch left join last using (rec_id, channel)""")
def track_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(c("l_partkey") % 5 > 0, F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyy-MM-dd"))).otherwise(" ")
    tracks = table(spark, sf, "lineitem").select(c("l_orderkey").alias("rec_id"), c("l_linenumber").alias("ord"), (c("l_partkey") % 4).alias("channel_index"), name.alias("name"))
    channels = table(spark, sf, "orders").select(c("o_orderkey").alias("rec_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("channel"))
    return M.track_names(tracks, channels)


@query("batch_progress", "select o_custkey as batch_id, count(*) filter (where o_orderstatus = 'F') as n_finished, count(*) as n_jobs, sum(case when o_orderstatus = 'F' then 1.0::double when o_orderstatus = 'O' then (o_orderkey % 8) / 8.0::double else 0 end) / count(*) as progress from orders group by 1")
def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    return M.batch_progress(table(spark, sf, "orders").select(c("o_custkey").alias("batch_id"), (c("o_orderstatus") == "F").alias("finished"), F.when(c("o_orderstatus") == "O", (c("o_orderkey") % 8) / 8.0).alias("partial")))


@query("filter_asks", "select p_partkey, p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_size > 40 as asks from part")
def filter_asks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(c("p_partkey") % 5 == 0, c("p_name")).otherwise("").alias("words"), F.when(c("p_partkey") % 7 == 0, "wav").otherwise("Any").alias("format"),
        F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"), F.when(c("p_size") > 40, c("p_size")).alias("shortest"), F.lit(None).cast("double").alias("longest"),
    )
    return M.asks(rows).select("p_partkey", "asks")
