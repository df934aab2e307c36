"""Queries over listings: the catalog's operators on `part` seen as files and `orders` seen as dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.order import natural_key, natural_key_sql
from ..operators import catalog as C
from ..registry import query
from ..views import FILES, STAMPS, files, stamps, table

c = F.col

_KEY = natural_key_sql("lower(name)")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """files with the dates of the order of the same number, a day's precision or a year's."""
    d = F.col("o_orderdate")
    start = F.when(F.col("o_orderkey") % 3 == 0, F.date_trunc("year", d).cast("timestamp_ntz")).otherwise(d)
    end = F.when(F.col("o_orderkey") % 3 == 0, F.date_trunc("year", d).cast("timestamp_ntz") + F.expr("interval 1 year")).otherwise(d + F.expr("interval 1 day"))
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec_id"), F.array(F.struct(F.lit("recorded").alias("kind"), start.alias("start"), end.alias("end"))).alias("dates"))
    return files(spark, sf).join(dates, "rec_id", "left")


LISTING = f"""{FILES}, listing as (select f.*, case when o_orderkey % 3 = 0 then date_trunc('year', o_orderdate)::timestamp else o_orderdate end as start,
 case when o_orderkey % 3 = 0 then date_trunc('year', o_orderdate)::timestamp + interval 1 year else o_orderdate + interval 1 day end as stop
 from files f left join orders on rec_id = o_orderkey)"""


@query("search_filter", f"with {LISTING} select rec_id, path, bytes, seconds from listing where (contains(lower(name || chr(10) || title), 'widget') or contains(lower(folder), 'widget')) and (contains(lower(name || chr(10) || title), 'econ') or contains(lower(folder), 'econ')) and extension in ('wav','wave','w64','rf64','bwf') and start >= timestamp '1993-01-01' and stop <= timestamp '2000-01-01' and seconds between 2 and 45")
def search_filter(spark: SparkSession, sf: str) -> DataFrame:
    ask = C.Search(words="WIDGET econ", format="wav", since="1993-01-01", until="2000-01-01", shortest=2, longest=45)
    return C.search(_listing(spark, sf), ask).select("rec_id", "path", "bytes", "seconds")


@query("search_words", f"with {FILES} select rec_id, path from files where (contains(lower(name || chr(10) || title), 'brand#1') or contains(lower(folder), 'brand#1')) and (contains(lower(name || chr(10) || title), 'cold') or contains(lower(folder), 'cold'))")
def search_words(spark: SparkSession, sf: str) -> DataFrame:
    return C.search(files(spark, sf), C.Search(words='Brand#1 "COLD"')).select("rec_id", "path")


@query("filter_format", f"with {FILES} select rec_id, extension from files where extension in ('mp3')")
def filter_format(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(C.Search(format="mp3").condition()).select("rec_id", "extension")


@query("filter_date_interval", f"with {LISTING} select rec_id, path from listing where start >= timestamp '1995-01-01' and stop <= timestamp '1996-01-01'")
def filter_date_interval(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf).where(C.Search(since="1995-01-01", until="1996-01-01").condition()).select("rec_id", "path")


@query("filter_length", f"with {FILES} select rec_id, seconds from files where seconds >= 10 and seconds <= 20")
def filter_length(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(C.Search(shortest=10, longest=20).condition()).select("rec_id", "seconds")


@query("is_audio", f"with {FILES} select extension, (extension in ('wav','mp3','flac','ogg')) audio, count(*)::bigint n from files group by all")
def is_audio(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).groupBy("extension", C.is_audio(F.col("extension")).alias("audio")).agg(F.count("*").alias("n"))


@query("list_dir", f"with {FILES} select folder, count(*) filter (extension <> 'txt')::bigint shown, count(*) filter (extension = 'txt')::bigint others, arg_min(name, {_KEY} || name) filter (extension <> 'txt') first_name from files group by folder")
def list_dir(spark: SparkSession, sf: str) -> DataFrame:
    audio = C.is_audio(F.col("extension"))
    first = F.min_by(F.col("name"), F.when(audio, F.concat(natural_key(F.lower("name")), "name"))).alias("first_name")
    return files(spark, sf).groupBy("folder").agg(F.count_if(audio).alias("shown"), F.count_if(~audio).alias("others"), first)


@query("natural_order", f"with {FILES} select path, {_KEY} as sort_key, row_number() over (partition by folder order by {_KEY}, path)::bigint as place from files")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    key = natural_key(F.lower("name"))
    return files(spark, sf).withColumn("sort_key", key).select("path", "sort_key", F.row_number().over(Window.partitionBy("folder").orderBy("sort_key", "path")).cast("long").alias("place"))


@query("search_order", f"with {FILES} select path from files order by {natural_key_sql('lower(folder)')}, {_KEY}, path")
def search_order(spark: SparkSession, sf: str) -> DataFrame:
    return C.search(files(spark, sf), C.Search()).select("path")


@query("matched_in", f"with {FILES} select rec_id, array_to_string(list_filter([case when contains(lower(name), 'brass') or contains(lower(name), 'eco') then 'Name' end, case when contains(lower(folder), 'brass') or contains(lower(folder), 'eco') then 'Folder' end, case when contains(lower(title), 'brass') or contains(lower(title), 'eco') then 'Title' end], lambda x: x is not null), ',') labels from files")
def matched_in(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("rec_id", F.array_join(C.matched_in("brass ECO", {"Name": "name", "Folder": "folder", "Title": "title"}), ",").alias("labels"))


@query("tokenize_query", """select conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all('"' || left(text, 12) || '"' || substr(text, 13) || ' **.WAV ab"Cd ef" "  " " x"' , '"[^"]*"?|\\S+'),
 lambda w: lower(regexp_replace(regexp_replace(w, '^"([^"]*)"?$', '\\1'), '^[*]+', ''))), lambda w: trim(w) <> ''), '|') as words from conversations""")
def tokenize_query(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as searches, with a phrase in quotes at their head, and quotes inside a word and around blanks at their end."""
    text = F.concat(F.lit('"'), F.substring("text", 1, 12), F.lit('"'), F.substring(F.col("text"), F.lit(13), F.length("text")), F.lit(' **.WAV ab"Cd ef" "  " " x"'))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.words_of(text), "|").alias("words"))


@query("dates_offered", "select 'recorded' kind, count(*)::bigint n from orders union all select 'shipped', count(*)::bigint from lineitem where l_returnflag = 'R' having count(*) > 0 union all select 'modified', 0 union all select 'created', 0")
def dates_offered(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "orders").select(F.lit("recorded").alias("kind")).unionAll(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.lit("shipped").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))
    always = spark.createDataFrame([("modified",), ("created",)], "kind string")
    return found.unionByName(always.join(found, "kind", "left_anti").withColumn("n", F.lit(0).cast("long")))


@query("incremental_reuse", f"with {FILES}, cache as (select path, bytes + case when rec_id % 5 = 0 then 1 else 0 end bytes from files where rec_id % 11 <> 0) select f.path, case when c.path is null then 'read' else 'reuse' end as what from files f left join cache c on f.path = c.path and f.bytes = c.bytes")
def incremental_reuse(spark: SparkSession, sf: str) -> DataFrame:
    now = files(spark, sf).select("rec_id", "path", "bytes", F.lit(0).alias("modified"))
    cache = now.where("rec_id % 11 <> 0").select("path", (F.col("bytes") + F.when(F.col("rec_id") % 5 == 0, 1).otherwise(0)).alias("bytes"), "modified")
    same, again = C.reuse(now, cache)
    return same.select("path", F.lit("reuse").alias("what")).unionByName(again.select("path", F.lit("read").alias("what")))


@query("step_navigate", f"with {FILES} select path, lag(path) over w previous, lead(path) over w as next from files window w as (partition by folder order by {_KEY}, path)")
def step_navigate(spark: SparkSession, sf: str) -> DataFrame:
    return C.neighbours(files(spark, sf), ["name"]).select("path", "previous", "next")


@query("search_status", f"with {FILES} select count(*) filter (extension = 'wav')::bigint matched, count(*)::bigint total, count(*) filter (seconds is null)::bigint unreadable from files")
def search_status(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).agg(F.count_if(F.col("extension") == "wav").alias("matched"), F.count("*").alias("total"), F.count_if(F.col("seconds").isNull()).alias("unreadable"))


@query("filter_mask", f"with {FILES} select rec_id, name from files where regexp_matches(name, '^(?:.*[.]wav|s.*1.*)$', 'i') and extension <> 'txt'")
def filter_mask(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(F.col("name").rlike(T.mask_pattern("*.wav; s*1*")) & C.is_audio(F.col("extension"))).select("rec_id", "name")


_PARSED = f"""{STAMPS}, parts as (select *, regexp_extract(stamp, '^([0-9]{{4}})(?:[-:/.]([0-9]{{1,2}})(?:[-:/.]([0-9]{{1,2}}))?)?(?:[T ]([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?)?$', ['y','m','d','h','n','s']) a,
 regexp_extract(stamp, '^([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{4}})$', ['d','m','y']) b from stamps),
 fields as (select rec_id, stamp, coalesce(try_cast(a.y as int), try_cast(b.y as int)) y, coalesce(try_cast(a.m as int), try_cast(b.m as int)) m, coalesce(try_cast(a.d as int), try_cast(b.d as int)) d,
 try_cast(a.h as int) h, try_cast(a.n as int) n, try_cast(a.s as int) s from parts),
 parsed as (select rec_id, stamp, case when y is null or h > 23 then null when m is null then 'year' when d is null then 'month' when h is null then 'day' when s is null then 'minute' else 'second' end p,
 make_timestamp(y, coalesce(m, 1), coalesce(d, 1), case when h > 23 then 0 else coalesce(h, 0) end, coalesce(n, 0), coalesce(s, 0)::double) as moment from fields)"""


@query("parse_stamp", f"with {_PARSED} select rec_id, stamp, case when p is not null then moment end as start, case p when 'year' then moment + interval 1 year when 'month' then moment + interval 1 month when 'day' then moment + interval 1 day when 'minute' then moment + interval 1 minute when 'second' then moment + interval 1 second end as stop from parsed")
def parse_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return stamps(spark, sf).withColumn("x", T.parse_stamp(F.col("stamp"))).select("rec_id", "stamp", "x.start", F.col("x.end").alias("stop"))


@query("stamp_text", f"with {_PARSED} select rec_id, case p when 'year' then strftime(moment, '%Y') when 'month' then strftime(moment, '%Y-%m') when 'day' then strftime(moment, '%Y-%m-%d') when 'minute' then strftime(moment, '%Y-%m-%d %H:%M') when 'second' then strftime(moment, '%Y-%m-%d %H:%M:%S') end as shown from parsed")
def stamp_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = stamps(spark, sf).withColumn("x", T.parse_stamp(F.col("stamp")))
    return rows.select("rec_id", F.when(F.col("x.start").isNotNull(), T.stamp_text(F.col("x.start"), F.col("x.end"))).alias("shown"))


@query("human_text", "select doc_id, nullif(array_to_string(list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(13) || chr(9)), '[\r\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^[a-z][A-Z0-9_]{1,15}=')), ' '), '') human from documents")
def human_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.human_text(F.replace("text", F.lit(". "), F.lit(".\r\t"))).alias("human"))


@query("xml_escape", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) escaped from pages")
def xml_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(T.xml_escape(F.col("html"))).alias("escaped"))


@query("crlf", "select doc_id, md5(replace(text, chr(10), chr(13) || chr(10))) as lines from (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') text from (select doc_id, replace(text, '. ', '.' || chr(13)) text from documents))")
def crlf(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.crlf(F.replace("text", F.lit(". "), F.lit(".\r")))).alias("lines"))


@query("incremental_search", f"""with {FILES}, scans as (select folder root, g generation, path, extension, seconds from files, (select unnest([1, 2, 3]) g) where rec_id % (g + 1) > 0),
 shows as (select distinct folder root, case right(folder, 1)::int % 3 when 0 then 1 when 1 then 2 else 3 end generation from files)
 select root, generation, path from scans join shows using (root, generation) where seconds >= 10 and extension in ('wav', 'flac')""")
def incremental_search(spark: SparkSession, sf: str) -> DataFrame:
    """Three scans of every folder, streamed in files of their own order; in a third of the folders none ends, in a third two do."""
    from ..sources.dataset import shared_folder
    from ..streaming import searching as W

    rows = files(spark, sf).withColumn("generation", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(c("rec_id") % (c("generation") + 1) > 0)
    rows = rows.select(c("folder").alias("root"), "generation", F.lit(False).alias("done"), "path", "extension", "seconds")
    many = F.substring("folder", -1, 1).cast("int") % 3
    ends = files(spark, sf).select("folder").distinct().withColumn("generation", F.explode(F.sequence(F.lit(1), F.lit(3)))).where((many == 1) & (c("generation") <= 2) | (many == 2))
    ends = ends.select(c("folder").alias("root"), "generation", F.lit(True).alias("done"), *[F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("extension", "string"), ("seconds", "double"))])
    folder = shared_folder(spark, "scans")
    rows.unionByName(ends).repartition(6, "path").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    W.start(stream, f"{folder}/out", lambda: C.Search(format="wav", shortest=10.0).condition() | C.Search(format="flac", shortest=10.0).condition()).awaitTermination()
    return W.shown(spark, f"{folder}/out").select("root", "generation", "path")
