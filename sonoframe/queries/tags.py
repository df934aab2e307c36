"""Queries over tags: `part` and `orders` as files with fields of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carrying as Y
from ..operators import tags as G
from ..operators.catalog import Search, search
from ..registry import query
from ..views import table

c = F.col
KINDS = ("id3v2", "mp4", "aiff", "vorbis", "ape", "id3v1", "guano")
KEYS = ("TIT2", "COMM", "COMM:note", "TXXX:my key", "TXXX", "PRIV:x", "©nam", "----:com.x:ITEM", "----:x", "NAME", "(c) ", "track_number", "a=b", "Title", "X", "GUANO|Version", "Loc:1", "TDOR", "WCOP", "USLT:")
_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_PAIRS = f"pairs as (select p_partkey, {list(KINDS)}[p_partkey % 7 + 1] kind, {_KEYS}[p_partkey // 7 % 20 + 1] as key from part)"


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", _pick(KINDS, c("p_partkey")).alias("kind"), _pick(KEYS, F.floor(c("p_partkey") / 7)).alias("key"))


@query("tag_labels", f"""with {_PAIRS} select p_partkey, case
 when kind = 'id3v2' then case key when 'TIT2' then 'Title' when 'COMM' then 'Comment' when 'TDOR' then 'Originally released' when 'WCOP' then 'Copyright page' when 'USLT:' then 'Lyrics'
   else case when instr(key, ':') > 0 then substr(key, instr(key, ':') + 1) else key end end
 when kind = 'mp4' then case when key = '©nam' then 'Title' else list_last(string_split(key, ':')) end
 when kind = 'aiff' then case key when 'NAME' then 'Name' when '(c) ' then 'Copyright' else key end
 when kind = 'vorbis' then upper(left(key, 1)) || replace(lower(substr(key, 2)), '_', ' ') else key end as label from pairs""")
def tag_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", G.label(c("kind"), c("key")).alias("label"))


@query("tag_keys", f"""with {_PAIRS} select p_partkey, case kind
 when 'id3v2' then key in ('TIT2', 'COMM', 'COMM:note', 'TXXX:my key', 'TDOR', 'WCOP', 'USLT:')
 when 'mp4' then key = '----:com.x:ITEM' or (length(key) = 4)
 when 'aiff' then key in ('NAME', 'AUTH', '(c) ', 'ANNO', 'COMT')
 when 'vorbis' then key not in ('©nam', 'a=b')
 when 'ape' then length(key) >= 2 and ascii(key) < 128
 when 'id3v1' then key = 'Title'
 else instr(key, ':') = 0 and key <> 'GUANO|Version' end allowed from pairs""")
def tag_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", G.key_allowed(c("kind"), c("key")).alias("allowed"))


@query("id3_text", """select p_partkey, case p_partkey % 5 when 0 then 'TPE1' when 1 then 'TXXX:' || p_brand when 2 then case when p_size % 2 = 0 then 'COMM' else 'COMM:' || p_brand end
 when 3 then 'WOAR' else 'WXXX:' || p_brand end as key, case when p_partkey % 5 < 2 then p_name || '; ' || p_type else p_name || chr(0) || p_type end as value from part""")
def id3_text(spark: SparkSession, sf: str) -> DataFrame:
    frame = _pick(("TPE1", "TXXX", "COMM", "WOAR", "WXXX"), c("p_partkey"))
    noted = F.when((c("p_partkey") % 5 == 2) & (c("p_size") % 2 == 0), "").otherwise(c("p_brand"))
    key, value = G.frame_field(frame, noted, F.concat("p_name", F.lit("\0"), "p_type"))
    return table(spark, sf, "part").select("p_partkey", key.alias("key"), value.alias("value"))


@query("bext_fits", """select o_orderkey, case when n > most then name || ' holds ' || most || ' bytes and has ' || n end as problem from (select o_orderkey, name, most, strlen(txt) + length(txt) - length(replace(txt, chr(10), '')) n
 from (select o_orderkey, ['Originator', 'Reference', 'Date', 'Time'][o_orderkey % 4 + 1] as name, [32, 32, 10, 8][o_orderkey % 4 + 1] most, o_orderpriority || chr(10) || repeat('õ', (o_orderkey % 17)::int) txt from orders))""")
def bext_fits(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("o_orderpriority", F.lit("\n"), F.repeat(F.lit("õ"), (c("o_orderkey") % 17).cast("int")))
    name = _pick(("Originator", "Reference", "Date", "Time"), c("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", G.bext_problem(name, text).alias("problem"))


_FIELDS = (("id3v2", "TDRC"), ("vorbis", "Date"), ("info", "ICMT"), ("ixml", "BWF_ORIGINATION_DATE"), ("id3v2", "TDEN"), ("ape", "TITLE"), ("mp4", "©day"))
_DATED = """dated as (select o_orderkey rec_id, o_orderkey % 7 k, o_orderdate::date::timestamp d, o_orderkey % 5 = 0 begun, (o_orderkey * 37 % 200000)::bigint s from orders)"""


def _dated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """orders as files with one dated field each, and starts of every fifth."""
    rows = table(spark, sf, "orders").select(c("o_orderkey").alias("rec_id"), (c("o_orderkey") % 7).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    source, key = (_pick(tuple(x[i] for x in _FIELDS), c("k")) for i in (0, 1))
    value = F.when(c("k") == 2, F.concat(F.lit("Recorded at 21:30:00 "), F.date_format(c("d").cast("date"), "dd/MM/yyyy"), F.lit(" (UTC+1) by a recorder"))).otherwise(c("d"))
    fields = rows.select("rec_id", F.lit(0).alias("ord"), source.alias("source"), key.alias("key"), value.alias("value"))
    clock = rows.where("k = 3").select("rec_id", F.lit(1).alias("ord"), F.lit("ixml").alias("source"), F.lit("BEXT / BWF_ORIGINATION_TIME").alias("key"), F.lit("21:30:05").alias("value"))
    starts = rows.where("rec_id % 5 = 0").select("rec_id", c("d").alias("date"), (c("rec_id") * 37 % 200000).cast("double").alias("seconds"))
    return fields.unionByName(clock), starts


_FOUND = f"""{_DATED}, found as (select rec_id, case when k = 4 then 'encoded' else 'recorded' end kind, case k when 2 then d + interval 77400 second when 3 then d + interval 77405 second else d end as start,
 case k when 2 then d + interval 77401 second when 3 then d + interval 77406 second else d + interval 1 day end as stop from dated where k <> 5 and not (k = 3 and begun)
 union all select rec_id, 'recorded', d + to_seconds(s % 86400), d + to_seconds(s % 86400 + 1) from dated where begun)"""


@query("dates_of", f'with {_FOUND} select rec_id, kind, start, stop as "end" from found')
def dates_of(spark: SparkSession, sf: str) -> DataFrame:
    return G.dates_of(*_dated(spark, sf))


@query("fields_of", """select p_partkey rec_id, 'Bit depth (Format)' as label, p_size::varchar as value from part
 union all select p_partkey, case when p_partkey % 2 = 0 then 'Title (ID3v2.4)' else 'Scientific name (Vorbis)' end, p_name from part
 union all select p_partkey, 'Marker', p_brand from part union all select p_partkey, 'Marker', p_type from part where p_partkey % 3 > 0""")
def fields_of(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("rec_id", c("p_partkey"))
    even = c("p_partkey") % 2 == 0
    details = part.select("rec_id", F.lit("Format").alias("section"), F.lit("Bit depth").alias("label"), c("p_size").cast("string").alias("value"))
    tags = part.select("rec_id", F.when(even, "id3v2").otherwise("vorbis").alias("kind"), F.when(even, "ID3v2.4").otherwise("Vorbis").alias("title"), F.when(even, "TIT2").otherwise("SCIENTIFIC_NAME").alias("key"), c("p_name").alias("value"))
    markers = part.select("rec_id", c("p_brand").alias("label"), F.when(c("p_partkey") % 3 > 0, c("p_type")).otherwise("").alias("note"))
    return G.fields_of(details, tags, markers)


@query("search_parsed", f"""with {_FOUND} select o_orderkey rec_id from orders where o_orderpriority in ('1-URGENT', '2-HIGH')
 and exists (select 1 from found where rec_id = o_orderkey and kind = 'recorded' and start >= timestamp '1995-01-01' and stop <= timestamp '1997-01-01')""")
def search_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """A search by text and date over what dates_of and fields give, not over columns made for it."""
    orders = table(spark, sf, "orders").select(c("o_orderkey").alias("rec_id"), "o_orderpriority")
    files = orders.select("rec_id", F.lit("/lib").alias("folder"), c("rec_id").cast("string").alias("name"), F.concat(F.lit("/lib/"), "rec_id").alias("path"))
    texts = orders.select("rec_id", F.lit("Priority").alias("label"), c("o_orderpriority").alias("value"))
    catalog = G.catalogued(files, texts, G.dates_of(*_dated(spark, sf)))
    ask = lambda word: search(catalog, Search(words=word, since="1995-01-01", until="1997-01-01", text_columns=("text",)))
    return ask("urgent").select("rec_id").unionByName(ask("high").select("rec_id"))


# kind and key of a field, and the key that it has in vorbis, id3v2 and mp4
_CARRIED = (
    ("id3v2", "TIT2", "TITLE", "TIT2", "\u00a9nam"), ("id3v2", "TXXX:my=key", "my_key", "TXXX:my=key", "----:com.apple.iTunes:my=key"), ("id3v2", "TSRC", "ISRC", "TSRC", "----:com.apple.iTunes:ISRC"),
    ("mp4", "----:com.x:Note", "Note", "TXXX:Note", "----:com.x:Note"), ("mp4", "\u00a9too", "ENCODER", "TSSE", "\u00a9too"), ("vorbis", "albumartist", "ALBUMARTIST", "TPE2", "aART"),
    ("vorbis", "caf\u00e9", "caf_", "TXXX:caf\u00e9", "----:com.apple.iTunes:caf\u00e9"), ("ape", "album artist", "ALBUMARTIST", "TPE2", "aART"), ("ape", "Record Date", "Record Date", "TXXX:Record Date", "----:com.apple.iTunes:Record Date"),
    ("id3v2", "WOAR", "WOAR", "WOAR", "----:com.apple.iTunes:WOAR"), ("mp4", "----:com.apple.iTunes:iTunSMPB", None, None, None),
)


def _carried_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A field of each part, twice in every third; a number with a total in half of them."""
    k = c("p_partkey") % len(_CARRIED)
    one = F.struct(F.lit(1).alias("ord"), _pick(tuple(x[0] for x in _CARRIED), k).alias("kind"), _pick(tuple(x[1] for x in _CARRIED), k).alias("key"), F.concat("p_name", F.lit("\0")).alias("value"))
    again = F.struct(F.lit(2).alias("ord"), one["kind"].alias("kind"), one["key"].alias("key"), c("p_name").alias("value"))
    number = F.struct(F.lit(3).alias("ord"), F.lit("vorbis").alias("kind"), F.lit("TrackNumber").alias("key"), F.concat(F.lit(" "), c("p_size").cast("string"), F.lit(" / 60")).alias("value"))
    blank = F.struct(F.lit(4).alias("ord"), F.lit("ape").alias("kind"), F.lit("Title").alias("key"), F.lit(" \0").alias("value"))
    none = F.lit(None).cast("struct<ord:int,kind:string,key:string,value:string>")
    rows = table(spark, sf, "part").select(c("p_partkey").alias("rec_id"), F.explode(F.array(one, F.when(c("p_partkey") % 3 == 0, again).otherwise(none), F.when(c("p_partkey") % 2 == 0, number).otherwise(none), blank)).alias("x"))
    return rows.where("x is not null").select("rec_id", "x.*")


for _to, _at, _track, _total in (("vorbis", 2, "TRACKNUMBER", "TRACKTOTAL"), ("id3v2", 3, "TRCK", None), ("mp4", 4, "----:com.apple.iTunes:TRACKNUMBER", "----:com.apple.iTunes:TRACKTOTAL")):
    _own = "[" + ", ".join("null" if x[_at] is None else f"'{x[_at]}'" for x in _CARRIED) + "]"
    _numbers = f"select p_partkey, 3, 0, '{_track}', p_size::varchar from part where p_partkey % 2 = 0 union all select p_partkey, 3, 1, '{_total}', '60' from part where p_partkey % 2 = 0" if _total else f"select p_partkey, 3, 0, '{_track}', p_size || '/60' from part where p_partkey % 2 = 0"

    @query(f"carry_to_{_to}", f"select * from (select p_partkey rec_id, 1 ord, 0 part, {_own}[p_partkey % {len(_CARRIED)} + 1] as key, p_name as value from part) where key is not null union all {_numbers}")
    def _carry(spark: SparkSession, sf: str, to: str = _to) -> DataFrame:
        return Y.carried(_carried_fields(spark, sf), to)
