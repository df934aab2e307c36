"""Queries over the conversion planner: `part` as files in every shape, `lineitem` as their markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import markers as K
from ..plans import convert as V
from ..registry import query
from ..views import FILES, files, table

c = F.col
FORMATS, RATES = ("wav", "flac", "m4a", "mp3", "ogg", "caf", "mka", "webm", "aiff"), (8000, 44100, 48000, 88200, 705600)
CODINGS, DEPTHS = ("int", "float", "lossy"), ("as file", "16", "24", "float")


def _pick(values: tuple, by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) % len(values)).cast("int") + 1)


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda by, what: F.when(F.expr(by), F.lit(what))
    rows = table(spark, sf, "part").select(
        "p_partkey", _pick(FORMATS, "p_partkey").alias("format"), _pick(RATES, "p_partkey div 9").cast("long").alias("rate"), (c("p_size") % 10 + 1).cast("long").alias("channels"),
        _pick(CODINGS, "p_partkey div 45").alias("coding"), _pick((8, 16, 20, 24, 32), "p_size").cast("long").alias("bits"),
        F.when(c("p_partkey") % 7 == 0, F.lit(96000)).cast("long").alias("wanted_rate"), _pick(DEPTHS, "p_size div 5").alias("wanted_depth"),
        F.array_compact(F.array(has("p_partkey % 2 = 0", "lengths"), has("p_partkey % 3 = 0", "notes"), has("p_size % 3 = 0", "pictures"))).alias("features"), (c("p_size") * 8).alias("markers"),
    )
    return V.shape(rows)


_NAME = "case format when 'wav' then 'WAV' when 'flac' then 'FLAC' when 'm4a' then 'M4A (ALAC)' when 'mp3' then 'MP3' when 'ogg' then 'Ogg Vorbis' when 'caf' then 'CAF' when 'mka' then 'MKA (FLAC)' when 'webm' then 'WebM (Vorbis)' else 'AIFF' end"
_KHZ = "regexp_replace(({x} / 1000)::decimal(12,3)::varchar, '[.]?0+$', '') || ' kHz'"
_SHAPES = f"""src as (select p_partkey, ['wav','flac','m4a','mp3','ogg','caf','mka','webm','aiff'][p_partkey % 9 + 1] format, [8000,44100,48000,88200,705600][p_partkey // 9 % 5 + 1]::bigint rate, p_size % 10 + 1 channels,
 ['int','float','lossy'][p_partkey // 45 % 3 + 1] coding, [8,16,20,24,32][p_size % 5 + 1]::bigint bits, case when p_partkey % 7 = 0 then 96000 end wanted_rate, ['as file','16','24','float'][p_size // 5 % 4 + 1] wanted,
 p_partkey % 2 = 0 lengths, p_partkey % 3 = 0 notes, p_size % 3 = 0 pictures, p_size * 8 markers from part),
 a as (select *, {_NAME} as name, coalesce(wanted_rate, rate) asked, format in ('wav', 'aiff', 'caf') can_float, format in ('mp3', 'ogg', 'webm') lossy, case format when 'flac' then 8 when 'm4a' then 8 when 'mka' then 8 when 'mp3' then 2 when 'ogg' then 255 when 'webm' then 255 else 65535 end most from src),
 b as (select *, case when format = 'mp3' then case when asked > 48000 and asked % 11025 = 0 then 44100 else coalesce(list_min(list_filter([8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000], lambda x: x >= asked)), 48000) end when format in ('ogg', 'webm') then case when asked > 400000 then asked // 4 when asked > 200000 then asked // 2 else asked end else asked end::bigint to_rate,
 case wanted when '16' then 16 when '24' then 24 when 'float' then case when can_float then 32 else 24 end else case coding when 'int' then bits when 'float' then case when can_float then 32 else 24 end else 16 end end depth,
 can_float and (wanted = 'float' or wanted = 'as file' and coding = 'float') is_float from a),
 shapes as (select *, case when lossy or is_float then null when format = 'm4a' then case when depth <= 16 then 16 when depth <= 20 then 20 when depth <= 24 then 24 else 32 end when format in ('flac', 'mka') then greatest(4, least(depth, 32)) else least(greatest(ceil(depth / 8) * 8, case when format = 'caf' then 16 else 8 end), 32) end::bigint to_bits, lossy or is_float to_float,
 case when channels > most then name || ' holds at most ' || most || ' channels; this file has ' || channels when format in ('flac', 'mka') and asked > 655350 then 'FLAC keeps rates up to 655.35 kHz; this file is ' || {_KHZ.format(x="asked")} || ': pick a lower rate, or WAV, CAF or M4A keep it' end error from b),
 said as (select *, case when to_float then '32-bit float' else to_bits || '-bit' end now_, case coding when 'int' then bits || '-bit' when 'float' then '32-bit float' end was,
 list_filter([case when lengths and format in ('m4a', 'caf') then 'lengths' end, case when notes and format in ('m4a', 'caf', 'mka', 'webm') then 'notes' end], lambda x: x is not null) gone from shapes)"""


@query("plan_shape", f"""with {_SHAPES} select p_partkey, to_rate, to_bits, to_float, error, array_to_string(list_filter([
 case when to_rate <> rate then {_KHZ.format(x='to_rate')} || ' from ' || {_KHZ.format(x='rate')} || case when to_rate = asked then '' when format = 'mp3' then ' (MP3 keeps 8 to 48 kHz, in steps)' else ' (Vorbis keeps up to 200 kHz)' end end,
 case when lossy then null when was is null then now_ when was <> now_ then now_ || ' from ' || was end, case when lossy and coding = 'lossy' then 'encoded again from a lossy file' end, case when pictures and format in ('caf', 'webm') then name || ' has no place for its pictures' end,
 case when len(gone) > 0 then 'its markers'' ' || array_to_string(gone, ' and ') || ' have no place in ' || name end, case when format = 'm4a' and markers > 255 then 'M4A keeps its first 255 markers' end], lambda x: x is not null), '; ') changes from said""")
def plan_shape(spark: SparkSession, sf: str) -> DataFrame:
    return _shapes(spark, sf).select("p_partkey", "to_rate", "to_bits", "to_float", "error", F.array_join("changes", "; ").alias("changes"))


@query("needs_peak", f"with {_SHAPES} select p_partkey, not to_float and (coding <> 'int' or to_rate <> rate) needed from shapes")
def needs_peak(spark: SparkSession, sf: str) -> DataFrame:
    rows = _shapes(spark, sf)
    return rows.select("p_partkey", V.needs_peak(rows).alias("needed"))


@query("lost_features", "select p_partkey, array_to_string(list_filter(case when p_partkey % 2 = 0 then ['lengths', 'notes', 'pictures'] else ['notes'] end, lambda x: list_contains(case p_partkey % 9 when 2 then ['lengths', 'notes'] when 5 then ['lengths', 'notes', 'pictures'] when 6 then ['notes'] when 7 then ['notes', 'pictures'] else []::varchar[] end, x)), ',') lost from part")
def lost_features(spark: SparkSession, sf: str) -> DataFrame:
    has = F.when(c("p_partkey") % 2 == 0, F.array(F.lit("lengths"), F.lit("notes"), F.lit("pictures"))).otherwise(F.array(F.lit("notes")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(V.lost(_pick(FORMATS, "p_partkey"), has), ",").alias("lost"))


@query("rescale_positions", "select l_orderkey, l_linenumber, (l_partkey::hugeint * 12345678 * 48000 // 44100)::bigint frame, ((l_quantity * 1000)::bigint::hugeint * 48000 // 44100)::bigint length from lineitem")
def rescale_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") * 12345678).alias("frame"), (c("l_quantity") * 1000).cast("long").alias("length"), F.lit(44100).alias("rate"), F.lit(48000).alias("to"))
    return V.carried(rows, "rate", "to").drop("rate", "to")


_MARKS = "marks as (select l_orderkey rec_id, 'm' || l_linenumber label, (l_quantity * 1000)::bigint frame from lineitem)"


@query("carry_check", f"with {_MARKS}, out as (select rec_id, label, frame + case when frame % 3000 = 0 then 60 when frame % 2000 = 0 then 44 else 0 end frame from marks) select rec_id, label, frame from marks b where not exists (select 1 from out a where a.rec_id = b.rec_id and a.label = b.label and abs(a.frame - b.frame) * 1000 <= 48000)")
def carry_check(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "lineitem").select(c("l_orderkey").alias("rec_id"), F.concat(F.lit("m"), c("l_linenumber").cast("string")).alias("label"), (c("l_quantity") * 1000).cast("long").alias("frame"))
    after = before.withColumn("frame", c("frame") + F.when(c("frame") % 3000 == 0, 60).when(c("frame") % 2000 == 0, 44).otherwise(0))
    return V.lost_markers(before, after, 48000)


@query("carry_problems", """select o_orderkey rec_id, case when k = 0 then 'tag ARTIST is missing' when k = 1 and o_orderkey % 3 < 2 then 'front picture is missing' when k = 2 then (n - 1) || ' markers came back of ' || n when k in (3, 4) then 'marker "m' || least_ || '" moved or lost its name' end problem
 from (select o_orderkey, o_orderkey % 8 k, n, least_ from orders join (select l_orderkey, count(distinct l_linenumber) n, min(l_linenumber) least_ from lineitem group by all) on l_orderkey = o_orderkey)""")
def carry_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files, in three formats, their lines as markers: one loses a field, one a picture (which CAF has no
    place for), one a marker; one marker moves too far, one changes its name, one moves a little; numbers lose zeros."""
    lines = table(spark, sf, "lineitem").select(c("l_orderkey").alias("rec_id"), c("l_linenumber").alias("id")).repartition("rec_id").distinct()
    marks = lines.select("rec_id", "id", (c("id") * 48000).cast("long").alias("frame"), F.concat(F.lit("m"), c("id").cast("string")).alias("label"))
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "rec_id")
    k, form = c("rec_id") % 8, F.element_at(F.array(F.lit("wav"), F.lit("flac"), F.lit("caf")), (c("rec_id") % 3 + 1).cast("int"))
    files = orders.select("rec_id", form.alias("format"), F.lit(48000).alias("rate")).join(lines, "rec_id", "left_semi")
    # fields and pictures of orders without lines are left to carry_problems, which ignores them
    field = lambda i, key, value: F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(key).alias("name"), value.alias("value"))
    artist = F.concat(F.lit("by "), c("o_orderstatus"))
    fields = orders.select("rec_id", F.explode(F.array(field(1, "TITLE", c("o_orderpriority")), field(2, "ARTIST", artist), field(3, "TRACKNUMBER", F.lit("03")))).alias("x")).select("rec_id", "x.*")
    back = fields.where(~((k == 0) & (c("name") == "ARTIST"))).withColumn("value", F.when(c("name") == "TRACKNUMBER", "3").otherwise(c("value")))
    joined = F.array_join(F.array_sort(F.array_compact(F.array("o_orderpriority", F.when(k != 0, artist), F.lit("3")))), "; ")
    together = orders.where(form == "caf").select("rec_id", F.lit(1).alias("ord"), F.lit("all").alias("key"), F.lit(None).cast("string").alias("name"), joined.alias("value"))
    pictures = orders.select("rec_id", F.lit(1).alias("ord"), F.lit("front").alias("kind"), F.encode(c("rec_id").cast("string"), "utf-8").alias("content"))
    first = c("id") == F.min("id").over(Window.partitionBy("rec_id"))
    after = marks.withColumn("first", first).where(~(c("first") & (k == 2))).withColumn("frame", c("frame") + F.when(c("first"), F.when(k == 3, 49).when(k == 5, 48).otherwise(0)).otherwise(0)).withColumn("label", F.when(c("first") & (k == 4), "x").otherwise(c("label"))).drop("first")
    return V.carry_problems(files, fields, pictures, marks, back.where(form != "caf").unionByName(together), pictures.where(k != 1), after)


@query("next_free_name", f"""with {FILES}, w as (select folder, rec_id place, lower(split_part(name, ' ', 1)) stem from files), k as (select *, row_number() over (partition by folder, stem order by place) k from w),
 taken as (select folder, lower(split_part(name, ' ', 1)) stem, case rec_id % 6 when 0 then 1 when 1 then 2 else 4 end n from files where rec_id % 6 < 3),
 free as (select s.folder, s.stem, n, row_number() over (partition by s.folder, s.stem order by n) k from (select distinct folder, stem from w) s, (select unnest(generate_series(1, (select max(k) + 3 from k))) n) where (s.folder, s.stem, n) not in (select (folder, stem, n) from taken))
 select k.folder, k.place, case when n = 1 then stem else stem || ' ' || n end || '.flac' as name from k join free using (folder, stem, k)""")
def next_free_name(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files have taken a name that others would get: the first, the second or the fourth, in capitals."""
    rows = files(spark, sf)
    stem = F.lower(F.split("name", " ")[0])
    wanted = rows.select("folder", c("rec_id").alias("place"), stem.alias("stem"), F.lit("flac").alias("ext"))
    number = F.when(c("rec_id") % 6 == 0, "").when(c("rec_id") % 6 == 1, " 2").when(c("rec_id") % 6 == 2, " 4")
    return V.free_names(wanted, rows.select("folder", F.upper(F.concat(stem, number, F.lit(".flac"))).alias("name")))


def _arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(c("vec_id").alias("rec_id"), c("embedding").cast("array<double>").alias("samples"))


#: A 64-bit number v times the hash's factor, modulo 2^64, in parts that 128 bits hold.
_STAR = 0x517CC1B727220A95
_MULTIPLIED = f"((({{v}} & 4294967295) * {_STAR} + (((({{v}} >> 32) * {_STAR & 0xFFFFFFFF}) & 4294967295) << 32)) & {(1 << 64) - 1})"


@query("sample_hash", """with b as (select vec_id, list_transform(embedding, lambda x: case when x = 0 then 0 else case when x < 0 then 2147483648 else 0 end + ((floor(log2(abs(x::double)))::bigint + 127) << 23) + ((abs(x::double) / pow(2, floor(log2(abs(x::double)))) - 1) * 8388608)::bigint end::hugeint) bits from embeddings),
 h as (select vec_id, list_reduce(bits, lambda h, x: {mul}, 14695981039346656037::hugeint) h from b) select vec_id rec_id, lpad(lower(to_hex(h::ubigint)), 16, '0') digest from h""".replace("{mul}", _MULTIPLIED.format(v=f"xor(((h << 5) & {(1 << 64) - 1}) | (h >> 59), x)")))
def sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.sample_hash(_arrays(spark, sf))


@query("nearest_preset", """select p_partkey, arg_min(v, [abs(ln(v) - ln(p_size / 10)), v]) filter (where v >= 1) speed, arg_min(v, [abs(ln(v) - ln(p_size / 10)), v]) slow_speed from part, (select unnest([0.1, 0.125, 0.25, 0.5, 1, 2, 4, 8])::double v) group by p_partkey, p_size""")
def nearest_preset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", N.nearest_preset(c("p_size") / 10, False).alias("speed"), N.nearest_preset(c("p_size") / 10, True).alias("slow_speed"))


@query("first_markers", "select l_orderkey rec_id, id, frame, row_number() over (partition by l_orderkey order by frame, id)::int place from (select l_orderkey, l_linenumber * 1000000 + l_partkey id, (l_quantity * 100)::bigint frame from lineitem) qualify place <= 3")
def first_markers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(c("l_orderkey").alias("rec_id"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("id"), (c("l_quantity") * 100).cast("long").alias("frame"))
    return K.first_markers(rows, 3)


@query("next_marker_id", "select o_orderkey rec_id, coalesce(max(l_linenumber), 0)::bigint + 1 next_id from orders left join lineitem on o_orderkey = l_orderkey and l_shipdate < timestamp '1997-01-01' group by o_orderkey")
def next_marker_id(spark: SparkSession, sf: str) -> DataFrame:
    """Of markers before a date, so that some files have none."""
    marks = table(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz '1997-01-01'").select(c("l_orderkey").alias("rec_id"), c("l_linenumber").alias("id"))
    return K.next_marker_ids(table(spark, sf, "orders").select(c("o_orderkey").alias("rec_id")), marks)


@query("verify", """select o_orderkey rec_id, case when k = 0 then 'unreadable' when k = 1 then 'format' when f < 2 then case when k between 2 and 4 then 'audio' end
 when k = 2 or (k = 3 and f < 4) or k = 5 then 'length' end problem from (select o_orderkey, o_orderkey % 7 k, o_orderkey // 7 % 5 f from orders)""")
def verify(spark: SparkSession, sf: str) -> DataFrame:
    k, f = c("rec_id") % 7, F.floor(c("rec_id") / 7) % 5  # two lossless formats, Ogg Vorbis, MP3 and WebM
    lossy = F.when(f == 2, "ogg").when(f == 3, "mp3").when(f == 4, "webm")
    digest = F.when(f < 2, F.md5(c("rec_id").cast("string")))
    rows = table(spark, sf, "orders").select(c("o_orderkey").alias("rec_id"), "o_custkey")
    written = rows.select("rec_id", F.coalesce(lossy, F.lit("wav")).alias("format"), F.lit(48000).alias("rate"), F.lit(2).alias("channels"), c("o_custkey").alias("frames"), digest.alias("hash"))
    more = F.when(k == 2, -1).when(k == 3, 4000).when((k == 5) & (f >= 2), 4097).when((k == 6) & (f == 3), 3409).otherwise(0)
    read = written.where(k != 0).select("rec_id", F.when(k == 1, 44100).otherwise(c("rate")).alias("rate"), "channels", (c("frames") + more).alias("frames"), F.when(k == 4, "other").otherwise(c("hash")).alias("hash"))
    return V.verified(written, read)


@query("export_name", """with w as (select p_partkey, p_brand folder, p_size, lower(split_part(p_name, ' ', 1)) || ' 1.00-' || printf('%.2f', 1 + p_size / 10.0) || ' s' stem from part), k as (select *, row_number() over (partition by folder, stem order by p_partkey) k from w),
 taken as (select distinct folder, stem from w where p_size % 2 = 0)
 select folder, p_partkey place, case when k + t = 1 then stem || '.png' else stem || ' ' || (k + t) || '.png' end as name from (select k.*, case when t.stem is null then 0 else 1 end t from k left join taken t using (folder, stem))""")
def export_name(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of even sizes stand there already."""
    stem = N.export_stem(F.lower(F.split("p_name", " ")[0]), F.lit(48000), 48000 + c("p_size") * 4800, F.lit(48000))
    wanted = table(spark, sf, "part").select(c("p_brand").alias("folder"), c("p_partkey").alias("place"), stem.alias("stem"), F.lit("png").alias("ext"), "p_size")
    return V.free_names(wanted.drop("p_size"), wanted.where("p_size % 2 = 0").select("folder", F.concat("stem", F.lit(".PNG")).alias("name")))
