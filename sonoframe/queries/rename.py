"""Queries over the rename planner: `part` as a listing, a batch for each brand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import natural_key_sql
from ..plans import rename as R
from ..registry import query
from ..views import FILES, files, table

c = F.col


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    recorded = table(spark, sf, "orders").where("o_orderkey % 4 > 0").select(c("o_orderkey").alias("rec_id"), c("o_orderdate").alias("recorded"))
    rows = files(spark, sf).join(recorded, "rec_id", "left")
    return rows.select(c("folder").alias("batch"), c("rec_id").alias("place"), "folder", "name", (c("rec_id") % 10 > 0).alias("chosen"), "recorded", "bytes")


_BATCHES = f"""{FILES}, batches as (select folder batch, rec_id place, folder, name, rec_id % 10 > 0 chosen, o_orderdate recorded, bytes,
 regexp_extract(name, '^(.+)[.]([^.]*)$', 1) stem, regexp_extract(name, '^(.+)[.]([^.]*)$', 2) ext
 from files left join (select * from orders where o_orderkey % 4 > 0) on rec_id = o_orderkey)"""


def _simple(name: str, rules: R.Rules, stem: str, ext: str = "ext"):
    """A query for rules whose new name SQL writes as one expression over stem and ext."""

    @query(name, f"with {_BATCHES} select place, name, ({stem}) || case when ({ext}) = '' then '' else '.' || ({ext}) end new_name from batches where chosen")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return R.plan(_batches(spark, sf), rules).select("place", "name", "new_name")


_simple("rx_replace", R.Rules(pattern=r"^(\w+) (\w+) (\d+)$", replacement=r"\3_\2-$1"), r"regexp_replace(stem, '^([A-Za-z0-9_]+) ([A-Za-z0-9_]+) ([0-9]+)$', '\3_\2-\1')")
_simple("name_mode", R.Rules(name="reverse"), "reverse(stem)")
_simple("text_replace", R.Rules(find="WIDGET", put="Take", any_case=True), "regexp_replace(stem, 'widget', 'Take', 'gi')")
_simple("recase", R.Rules(case="title", spelled=("WIDGET",)), "regexp_replace(array_to_string(list_transform(regexp_extract_all(stem, '[A-Za-z0-9'']+|[^A-Za-z0-9'']+'), lambda x: upper(x[1]) || lower(x[2:])), ''), 'Widget', 'WIDGET', 'g')")
_simple("remove", R.Rules(first=1, last=1, chars="e", crop=("before", "W"), digits=True, double_spaces=True, trim=True), "trim(regexp_replace(regexp_replace(case when instr(lower(r), 'w') > 0 then substr(r, instr(lower(r), 'w')) else r end, '[0-9]', '', 'g'), ' {2,}', ' ', 'g'))".replace("r)", "replace(substr(stem, 2, length(stem) - 2), 'e', ''))").replace("substr(r,", "substr(replace(substr(stem, 2, length(stem) - 2), 'e', ''),").replace("else r end", "else replace(substr(stem, 2, length(stem) - 2), 'e', '') end"))
_simple("move_copy", R.Rules(move=("first", 4, "end", "_")), "substr(stem, 5) || '_' || left(stem, 4)")
_simple("add_text", R.Rules(word_space=True, prefix="EE_", insert=("-", 5), suffix="_A"), "'EE_' || left(stem, 4) || '-' || substr(stem, 5) || '_A'")
_simple("add_folder", R.Rules(folders=("prefix", 2, "-")), "'lib-' || split_part(folder, '/', 3) || '-' || stem")
_simple("extension_rule", R.Rules(extension="lower"), "stem", "lower(ext)")
_simple("add_date", R.Rules(date=("prefix", "%Y-%m-%d", "_")), "case when recorded is null then stem else strftime(recorded, '%Y-%m-%d') || '_' || stem end")


_simple("copy_place", R.Rules(move=("copy last", 3, 6, "+")), "left(stem, 5) || '+' || right(stem, 3) || '+' || substr(stem, 6)")
_simple("extension_extra", R.Rules(extension="extra", fixed_extension=".bak"), "stem", "ext || '.bak'")
_simple("extension_title", R.Rules(extension="title", lead_dots=True), "stem", "upper(left(ext, 1)) || lower(substr(ext, 2))")
_simple("add_now", R.Rules(date=("suffix", "%Y%m%d", "-"), date_of="now", now=datetime(2024, 5, 1, 21, 30)), "stem || '-20240501'")
_simple("remove_accents", R.Rules(find="e", put="łé", accents=True), "replace(stem, 'e', 'le')")


_simple("remove_symbols", R.Rules(find="s", put="-s_(é)\t!", symbols=True, cut=(5, 2)), "replace(stem, 's', '-s_é')")
_simple("remove_cut", R.Rules(cut=(3, 6)), "left(stem, 2) || substr(stem, 7)")
_simple("date_formats", R.Rules(date=("suffix", "%d.%-m.%y %I%p %j %b %a%%", "_")), "case when recorded is null then stem else stem || '_' || strftime(recorded, '%d.%-m.%y %I%p %j %b %a%%') end")


@query("bad_rules", f"with {_BATCHES} select place, name new_name, 'rules' problem, false changing from batches where chosen")
def bad_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern that isn't one is every file's problem."""
    return R.plan(_batches(spark, sf), R.Rules(pattern="(", replacement="x")).select("place", "new_name", "problem", "changing")


@query("number_signed", f"""with {_BATCHES}, n as (select *, 3 - 2 * (row_number() over (partition by batch order by place) - 1) num from batches where chosen),
 t as (select *, abs(num) k from n) select place, case when num < 0 then '-' else '' end || case when k = 0 then '' when k <= 26 then chr(64 + k::int) else chr((64 + (k - 1) // 26)::int) || chr((65 + (k - 1) % 26)::int) end || case when k = 0 then '' else '.' end || stem || '.' || ext new_name from t""")
def number_signed(spark: SparkSession, sf: str) -> DataFrame:
    return R.plan(_batches(spark, sf), R.Rules(number=("prefix", 3, -2, 0, "."), numerals="upper")).select("place", "new_name")


@query("number_both", f"with {_BATCHES}, n as (select *, row_number() over (partition by batch order by place) || '' num from batches where chosen) select place, num || '_' || stem || '_' || num || '.' || ext new_name from n")
def number_both(spark: SparkSession, sf: str) -> DataFrame:
    return R.plan(_batches(spark, sf), R.Rules(number=("both", 1, 1, 0, "_"))).select("place", "new_name")


@query("add_modified", f"with {_BATCHES} select place, strftime(coalesce(recorded, timestamp '2020-02-03' + to_hours(place)), '%Y%m%d%H') || '_' || stem || '.' || ext new_name, null::varchar problem from batches where chosen")
def add_modified(spark: SparkSession, sf: str) -> DataFrame:
    rows = _batches(spark, sf).withColumn("modified", F.lit("2020-02-03").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), c("place").cast("int")))
    return R.plan(rows, R.Rules(date=("prefix", "%Y%m%d%H", "_"), or_modified=True)).select("place", "new_name", "problem")


@query("number_running", f"""with {_BATCHES}, t as (select *, left(stem, 1) k from batches where chosen), f as (select *, case when k <> lag(k) over (partition by batch order by place) then 1 else 0 end fresh from t),
 g as (select *, sum(fresh) over (partition by batch order by place) run from f), n as (select *, 5 + 2 * (row_number() over (partition by batch, run order by place) - 1) num from g)
 select place, name, lpad(num::varchar, greatest(3, length(num::varchar))::int, '0') || '_' || stem || '.' || ext new_name from n""")
def number_running(spark: SparkSession, sf: str) -> DataFrame:
    rules = R.Rules(number=("prefix", 5, 2, 3, "_"), restart_after=1)
    return R.plan(_batches(spark, sf), rules).select("place", "name", "new_name")


@query("insert_number", f"with {_BATCHES}, n as (select *, -7 + 5 * (row_number() over (partition by batch order by place) - 1) num from batches where chosen) select place, left(stem, 1) || case when num < 0 then '-' || lpad((-num)::varchar, greatest(3, length((-num)::varchar))::int, '0') else lpad(num::varchar, greatest(4, length(num::varchar))::int, '0') end || substr(stem, 2) || '.' || ext new_name from n")
def insert_number(spark: SparkSession, sf: str) -> DataFrame:
    return R.plan(_batches(spark, sf), R.Rules(insert_number=(2, -7, 5, 4))).select("place", "new_name")


@query("rename_collisions", f"""with {_BATCHES}, p as (select *, regexp_replace(stem, '[0-9]', '', 'g') || '.' || ext new_name from batches where chosen),
 q as (select *, new_name <> name changing, count(*) filter (new_name <> name) over (partition by batch, lower(folder || '/' || new_name)) sharing from p),
 stay as (select distinct batch, lower(folder || '/' || name) target from batches where (batch, lower(folder || '/' || name)) not in (select (batch, lower(folder || '/' || name)) from q where changing and not new_name ~ '.*\\s$'))
 select place, q.new_name, case when sharing > 1 then 'duplicate' when changing and s.target is not null then 'exists' end problem from q left join stay s on q.batch = s.batch and s.target = lower(folder || '/' || new_name)""")
def rename_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return R.plan(_batches(spark, sf), R.Rules(digits=True)).select("place", "new_name", "problem")


@query("rename_counts", f"with {_BATCHES}, p as (select *, case when recorded is null then null else 1 end ok from batches where chosen) select batch, count(*)::bigint chosen, count(ok)::bigint changing, (count(*) - count(ok))::bigint problems from p group by batch")
def rename_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.counts(R.plan(_batches(spark, sf), R.Rules(date=("suffix", "%Y%m%d", "_"))))


_KEY = natural_key_sql("lower(name)")


@query("rename_sort", f"with {_BATCHES} select batch, name, row_number() over (partition by batch order by recorded desc nulls last, {_KEY} desc, name desc)::bigint as at from batches".replace("::bigint as at", '::bigint as "at"'))
def rename_sort(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _batches(spark, sf)
    return rows.select("batch", "name", F.row_number().over(Window.partitionBy("batch").orderBy(*R.ordered(rows, "recorded", True))).cast("long").alias("at"))


@query("undo_batch", f"with {_BATCHES} select batch, upper(stem) || '.' || ext as name, name new_name from batches where chosen and upper(stem) <> stem")
def undo_batch(spark: SparkSession, sf: str) -> DataFrame:
    return R.undone(R.plan(_batches(spark, sf), R.Rules(case="upper"))).select("batch", "name", "new_name")
