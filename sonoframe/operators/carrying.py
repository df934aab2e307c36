"""Fields carried from one kind of tag to another: what each is called there, numbers and totals apart or together.

Defined results: fields with a null or blank value, or of keys that only hold for the old file, are left out; NULs at a
value's end go; a field that a file has twice, under one name in any case and with one value, is carried once, where it
stood first; kinds without a table of their own keep custom keys; no rows give no rows.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comment_key, number_split
from .tags import key_allowed

#: Fields by their Vorbis comment's name, and what ID3v2, MP4 and APE call them; None where one has no place for it.
FIELDS = {
    "TITLE": ("TIT2", "©nam", "Title"), "ARTIST": ("TPE1", "©ART", "Artist"), "ALBUM": ("TALB", "©alb", "Album"), "ALBUMARTIST": ("TPE2", "aART", "Album Artist"),
    "DATE": ("TDRC", "©day", "Year"), "GENRE": ("TCON", "©gen", "Genre"), "COMMENT": ("COMM", "©cmt", "Comment"), "COMPOSER": ("TCOM", "©wrt", "Composer"),
    "COPYRIGHT": ("TCOP", "cprt", "Copyright"), "LYRICS": ("USLT", "©lyr", "Lyrics"), "GROUPING": ("TIT1", "©grp", "Grouping"), "ENCODER": ("TSSE", "©too", None),
    "TRACKNUMBER": ("TRCK", "trkn", "Track"), "DISCNUMBER": ("TPOS", "disk", "Disc"), "TRACKTOTAL": (None, None, None), "DISCTOTAL": (None, None, None),
    "ISRC": ("TSRC", None, "ISRC"), "LANGUAGE": ("TLAN", None, "Language"), "MOOD": ("TMOO", None, "Mood"), "CONDUCTOR": ("TPE3", None, "Conductor"),
}
#: Numbers that a total may follow, keys that hold for the old file alone, and MP4's keys that aren't text.
TOTALS = {"TRACKNUMBER": "TRACKTOTAL", "DISCNUMBER": "DISCTOTAL"}
STALE = ("iTunSMPB",)
BINARY = ("trkn", "disk", "rate", "tmpo")
_PLACE = {"id3v2": 0, "mp4": 1, "ape": 2}


def _pick(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def known_name(kind: Column, key: Column) -> Column:
    """The Vorbis name of a field that all kinds know; null for one of its file's own."""
    out = F.when(kind == "vorbis", F.when(F.upper(key).isin(*FIELDS), F.upper(key)))
    for k, at in _PLACE.items():
        fold = F.lower if k == "ape" else lambda x: x
        table = {(row[at].lower() if k == "ape" else row[at]): name for name, row in FIELDS.items() if row[at]}
        out = out.when(kind == k, _pick(table, fold(key)))
    return out


def custom_name(kind: Column, key: Column) -> Column:
    """What a field of a file's own is called: what follows TXXX's colon or an MP4 item's last, or else its key."""
    return F.when((kind == "id3v2") & key.startswith("TXXX:"), F.substring(key, F.lit(6), F.length(key))).when((kind == "mp4") & key.startswith("----:"), F.substring_index(key, ":", -1)).otherwise(key)


def key_for(to: str, kind: Column, key: Column, name: Column, custom: Column) -> Column:
    """The key that a field goes under in a tag of kind `to`."""
    plain = F.coalesce(name, custom)
    own = F.when((kind == to) & key_allowed(F.lit(to), key), key)
    mapped = _pick({n: row[_PLACE[to]] for n, row in FIELDS.items() if row[_PLACE[to]]}, name) if to in _PLACE else F.lit(None).cast("string")
    if to == "vorbis":
        return F.coalesce(name, comment_key(custom))
    if to == "id3v2":
        totals = name.isin(*TOTALS.values())
        return F.when(F.coalesce(totals, F.lit(False)), F.concat(F.lit("TXXX:"), plain)).otherwise(F.coalesce(mapped, own, F.concat(F.lit("TXXX:"), plain)))
    if to == "mp4":
        return F.coalesce(F.when(~mapped.isin(*BINARY), mapped), own, F.concat(F.lit("----:com.apple.iTunes:"), plain))
    return F.coalesce(mapped, custom)


def carried(fields: DataFrame, to: str) -> DataFrame:
    """Of fields (rec_id, ord, kind, key, value): rec_id, ord, part, key and value in a tag of kind `to`.

    A number with a total becomes two fields, part 0 and 1; in ID3v2 a file's total goes behind its number again.
    """
    value = F.regexp_replace("value", "\0+\\z", "")
    rows = fields.withColumn("value", value).where(F.col("kind").isNotNull() & F.col("key").isNotNull() & ~F.col("value").rlike(r"(?U)^\s*\z"))
    for key in STALE:
        rows = rows.where(~F.col("key").endswith(key))
    rows = rows.withColumn("name", known_name(F.col("kind"), F.col("key"))).withColumn("custom", custom_name(F.col("kind"), F.col("key")))
    number, total = number_split(F.col("value"))
    both = F.col("name").isin(*TOTALS) & total.isNotNull()
    one = F.struct(F.lit(0).alias("part"), F.col("name"), F.when(both, number).otherwise(F.col("value")).alias("value"))
    two = F.struct(F.lit(1).alias("part"), _pick(TOTALS, F.col("name")).alias("name"), total.alias("value"))
    rows = rows.withColumn("x", F.explode(F.when(F.coalesce(both, F.lit(False)), F.array(one, two)).otherwise(F.array(one)))).select("rec_id", "ord", "kind", "key", "custom", "x.*")
    same = Window.partitionBy("rec_id", F.coalesce(F.concat(F.lit("+"), "name"), F.lower("custom")), "value").orderBy("ord", "part")
    rows = rows.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    if to == "id3v2":
        first = Window.partitionBy("rec_id", "name").orderBy("ord", "part")
        rows = rows.withColumn("turn", F.when(F.col("name").isNotNull(), F.row_number().over(first)))
        totals = rows.where(F.col("name").isin(*TOTALS.values()) & (F.col("turn") == 1)).select("rec_id", _pick({v: k for k, v in TOTALS.items()}, F.col("name")).alias("name"), F.lit(1).alias("turn"), F.col("value").alias("total"))
        numbers = rows.where(F.col("name").isin(*TOTALS) & (F.col("turn") == 1)).select("rec_id", _pick(TOTALS, F.col("name")).alias("name"), F.lit(1).alias("turn"))
        rows = rows.join(totals, ["rec_id", "name", "turn"], "left").join(numbers, ["rec_id", "name", "turn"], "left_anti")
        rows = rows.withColumn("value", F.concat("value", F.coalesce(F.concat(F.lit("/"), "total"), F.lit(""))))
    return rows.select("rec_id", "ord", "part", key_for(to, F.col("kind"), F.col("key"), F.col("name"), F.col("custom")).alias("key"), "value")
