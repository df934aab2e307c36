"""Queries of a lossless coder's work: `lineitem` as blocks of residuals, `events` as blocks of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding as K
from ..registry import query
from ..views import SERIES, series, table

c = F.col

# samples of a block that warm its predictor up
_WARM = 2


@query("rice_partition", f"""with k as (select l_orderkey // 4 b, (l_orderkey % 4 * 8 + l_linenumber) i, max(l_partkey) p from lineitem group by all),
 r as (select b, i, case when b % 9 = 0 then 0 when b % 9 = 1 then (p * 7919 % 2000003 - 1000000) * 1000 when i < 16 then p % 5 - 2 else p % 400 - 200 end v from k where i >= {_WARM}),
 n as (select b, max(i) + 1 n from r group by b), u as (select b, i, n, case when v < 0 then -2 * v - 1 else 2 * v end::bigint u from r join n using (b)),
 orders as (select unnest(generate_series(0, 8)) o), fits as (select b, n, o from n, orders where n % (1 << o)::bigint = 0 and (n >> o) > {_WARM}), most as (select b, n, o from fits f where not exists (select 1 from orders x where x.o < f.o and not exists (select 1 from fits y where y.b = f.b and y.o = x.o))),
 parts as (select b, o, p, len, s, w from (select u.b, m.o, u.i // (m.n >> m.o) p, count(*) len, sum(u) s, max(case when u >> 1 = 0 then 1 else 2 + floor(log2(u >> 1))::bigint end) w from u join most m using (b) group by all)),
 every as (select b, o, p, coalesce(len, 0) len, coalesce(s, 0) s, coalesce(w, 0) w from (select b, o, unnest(generate_series(0, (1 << o) - 1)) p from most) left join parts using (b, o, p)),
 tried as (select e.*, k, len * (k + 1) + coalesce((select sum(u.u >> k) from u where u.b = e.b and u.i // (u.n >> e.o) = e.p), 0) cost from every e, (select unnest(generate_series(0, 30)) k)
  where abs(k - case when len = 0 or s // len = 0 then 0 else floor(log2(s // len))::bigint end) <= 1),
 chosen as (select b, o, p, len, w, arg_min(k, cost * 100 + k) k, min(cost) cost from tried group by all),
 costs as (select *, len > 0 and len * w + 5 < cost raw from chosen),
 total as (select b, o, sum(case when raw then 5 + len * w else cost end) + count(*) * case when coalesce(max(k) filter (where not raw), 0) > 14 then 5 else 4 end + 6 bits,
  string_agg(case when raw then 'raw' else k::varchar end, ',' order by p) parameters, coalesce(max(w) filter (where raw), 0) raw, coalesce(max(k) filter (where not raw), 0) > 14 wide from costs group by all)
 select b, o::int "order", bits::bigint bits, parameters, raw::int raw, wide from total qualify row_number() over (partition by b order by bits, o) = 1""")
def rice_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Four orders' lines make a block, a line's number its place; silent, quiet and wild blocks."""
    rows = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 4").alias("b"), (c("l_orderkey") % 4 * 8 + c("l_linenumber")).alias("at"), "l_partkey")
    rows = rows.groupBy("b", "at").agg(F.max("l_partkey").alias("p")).where(c("at") >= _WARM)
    v = F.when(c("b") % 9 == 0, 0).when(c("b") % 9 == 1, (c("p") * 7919 % 2000003 - 1000000) * 1000).when(c("at") < 16, c("p") % 5 - 2).otherwise(c("p") % 400 - 200)
    out = K.rice_partitions(rows.withColumn("value", v), ["b"], _WARM)
    shown = F.array_join(F.transform("parameters", lambda x: F.coalesce(x.cast("string"), F.lit("raw"))), ",")
    return out.select("b", "order", "bits", shown.alias("parameters"), "raw", "wide")


_MOST = 3


@query("lpc_fit", f"""with recursive {SERIES}, s as (select rec_id, frame // 40 b, frame % 40 pos, round(x * 20000) v from series), n as (select *, count(*) over (partition by rec_id, b) n, row_number() over (partition by rec_id, b order by pos) - 1 i from s),
 t as (select *, greatest(n // 4, 1) taper from n), w as (select rec_id, b, n, i, v * case when i < taper then 0.5 - 0.5 * cos(pi() * i / taper) when i >= n - taper then 0.5 - 0.5 * cos(pi() * (n - 1 - i) / taper) else 1 end x from t),
 products as (select x.rec_id, x.b, x.n, k, sum(x.x * y.x) s from w x join w y on x.rec_id = y.rec_id and x.b = y.b and y.i <= x.i and x.i - y.i <= {_MOST} join (select unnest(generate_series(0, {_MOST})) k) on x.i - y.i = k group by all),
 auto as (select rec_id, b, n, list_transform(generate_series(0, {_MOST}), lambda j: coalesce(list_sum(list_filter(list(struct_pack(k := k, s := s)), lambda z: z.k = j).list_transform(lambda z: z.s)), 0)) r from products group by all),
 durbin as (select rec_id, b, n, r, 0 i, []::double[] a, r[1] e from auto where r[1] > 0
  union all select rec_id, b, n, r, i + 1, list_transform(generate_series(1, i), lambda j: a[j] - q * a[i + 1 - j]) || [q], e * (1 - q * q)
  from (select *, (r[i + 2] - coalesce(list_sum(list_transform(generate_series(1, i), lambda j: a[j] * r[i + 2 - j])), 0)) / e q from durbin where i < {_MOST} and e > 0)),
 shifts as (select *, least(7 - 1 - (floor(log2(list_max(list_transform(a, lambda x: abs(x)))))::int + 1), 15) shift from durbin where i > 0 and list_max(list_transform(a, lambda x: abs(x))) > 0),
 whole as (select *, list_reduce(a, lambda st, x: [st[1] + 0, 0], [0::double, 0]) z, list_transform(generate_series(1, i), lambda j: a[j] * pow(2, shift)) scaled from shifts where shift >= 0),
 rolled as (select rec_id, b, i, e, shift, scaled, 0 j, 0::double carry, []::int[] q from whole union all
  select rec_id, b, i, e, shift, scaled, j + 1, carry + scaled[j + 1] - g, q || [g::int] from (select *, greatest(-64, least(63, round(carry + scaled[j + 1]))) g from rolled where j < i))
 select rec_id, b, i::int "order", array_to_string(q, ',') coefficients, shift::int shift, round(e)::bigint error from rolled where j = i""".replace("list_reduce(a, lambda st, x: [st[1] + 0, 0], [0::double, 0]) z, ", ""))
def lpc_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Predictors of orders 1 to 3 for users' events, in blocks of 40; the last block of a user is short."""
    rows = series(spark, sf).select("rec_id", F.floor(c("frame") / 40).alias("b"), (c("frame") % 40).alias("at"), F.round(c("x") * 20000).alias("value"))
    out = K.predictors(rows, ["rec_id", "b"], _MOST, 16)
    return out.select("rec_id", "b", "order", F.array_join(F.col("coefficients").cast("array<string>"), ",").alias("coefficients"), "shift", F.round("error").cast("long").alias("error"))
