"""Tags of files: what their fields are called, which keys a kind takes, and the dates and texts that a search reads.

Kinds are id3v2, id3v1, mp4, aiff, vorbis, ape, guano and info (RIFF). Defined results: a null kind or key has a null name and is not
allowed; a null value is no date and no text; empty tables give empty tables; rows may repeat and keep their order by ord.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import crlf, parse_stamp, recorder_date

#: The names of ID3v2 frames.
ID3V2 = {
    "TIT1": "Grouping", "TIT2": "Title", "TIT3": "Subtitle", "TPE1": "Artist", "TPE2": "Album artist", "TPE3": "Conductor", "TPE4": "Remixed by",
    "TALB": "Album", "TRCK": "Track", "TPOS": "Disc", "TYER": "Year", "TDAT": "Date", "TIME": "Time", "TDRC": "Recorded", "TDRL": "Released",
    "TDOR": "Originally released", "TORY": "Originally released", "TCON": "Genre", "TCOM": "Composer", "TEXT": "Lyricist", "TCOP": "Copyright",
    "TPUB": "Publisher", "TENC": "Encoded by", "TSSE": "Encoder", "TBPM": "BPM", "TKEY": "Key", "TLAN": "Language", "TLEN": "Length", "TMED": "Media",
    "TMOO": "Mood", "TOAL": "Original album", "TOPE": "Original artist", "TOFN": "Original file name", "TOWN": "Owner", "TSRC": "ISRC",
    "TSOA": "Album for sorting", "TSOP": "Artist for sorting", "TSOT": "Title for sorting", "WOAR": "Artist's page", "WOAS": "Source's page",
    "WOAF": "File's page", "WCOP": "Copyright page", "WPUB": "Publisher's page", "WCOM": "Where to buy",
}
#: Frames that have these names only without a description.
ID3V2_BARE = {"COMM": "Comment", "USLT": "Lyrics"}
#: The names of MP4 atoms.
MP4 = {
    "©nam": "Title", "©ART": "Artist", "aART": "Album artist", "©alb": "Album", "©cmt": "Comment", "desc": "Description", "ldes": "Long description",
    "©day": "Date", "©gen": "Genre", "©wrt": "Composer", "©too": "Encoder", "cprt": "Copyright", "©lyr": "Lyrics", "©grp": "Grouping", "©pub": "Publisher",
}
#: The names of AIFF's text chunks, and all fields of ID3v1.
AIFF = {"NAME": "Name", "AUTH": "Author", "(c) ": "Copyright", "ANNO": "Annotation", "COMT": "Comment"}
ID3V1 = ("Title", "Artist", "Album", "Year", "Comment", "Track")
#: The names of RIFF INFO fields.
INFO = {
    "INAM": "Title", "IART": "Artist", "ICMT": "Comment", "ISBJ": "Subject", "IKEY": "Keywords", "ICRD": "Date", "IGNR": "Genre",
    "ICOP": "Copyright", "IENG": "Engineer", "ITCH": "Technician", "ISRC": "Source", "IPRD": "Product", "ISFT": "Software",
}
#: The bytes that a Broadcast WAV field holds.
BEXT_BYTES = {"Description": 256, "Originator": 32, "Reference": 32, "Date": 10, "Time": 8}
#: Which field of a kind names which date; vorbis and ape keys in any case.
DATES = (
    ("id3v2", "tdrc", "recorded"), ("mp4", "©day", "recorded"), ("guano", "timestamp", "recorded"), ("id3v1", "year", "recorded"), ("vorbis", "date", "recorded"),
    ("ape", "year", "recorded"), ("ape", "record date", "recorded"), ("info", "icrd", "recorded"), ("id3v2", "tdrl", "released"),
    ("id3v2", "tdor", "first released"), ("id3v2", "tden", "encoded"), ("id3v2", "tdtg", "tagged"),
)


def _named(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def label(kind: Column, key: Column) -> Column:
    """What a field is called: its kind's name, what follows a custom key's colon, or the key; vorbis keys as a sentence."""
    frame, bare = F.substring_index(key, ":", 1), _named(ID3V2_BARE, F.regexp_replace(key, r":\z", ""))
    described = F.when(key.contains(":"), F.regexp_extract(key, r"(?s)^[^:]*:(.*)\z", 1))
    words = F.replace(F.lower(key), F.lit("_"), F.lit(" "))
    return (
        F.when(kind == "id3v2", F.coalesce(_named(ID3V2, frame), bare, described, key))
        .when(kind == "mp4", F.coalesce(_named(MP4, key), F.substring_index(key, ":", -1)))
        .when(kind == "aiff", F.coalesce(_named(AIFF, key), key))
        .when(kind == "info", F.coalesce(_named(INFO, key), key))
        .when(kind == "vorbis", F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))
        .when(kind.isNotNull(), key)
    )


def key_allowed(kind: Column, key: Column) -> Column:
    """Whether a key can stand in a tag of a kind; false for unknown kinds and null keys."""
    frame = key.rlike(r"^([TW][A-Z0-9]{3}|COMM|USLT)\z") & ~key.isin("TXXX", "WXXX")
    allowed = (
        F.when(kind == "id3v2", F.when(key.contains(":"), key.rlike("^(TXXX|WXXX|COMM|USLT):")).otherwise(frame))
        .when(kind == "vorbis", key.rlike(r"^[ -<>-}]+\z"))
        .when(kind == "ape", key.rlike(r"(?s)^[\x00-\x7f]{2,255}\z"))
        .when(kind == "mp4", F.when(key.startswith("----:"), key.rlike(r"(?s)^----:[^:]+:.+\z")).otherwise(key.rlike(r"(?s)^[\x00-\xff]{4}\z")))
        .when(kind == "id3v1", key.isin(*ID3V1))
        .when(kind == "aiff", key.isin(*AIFF))
        .when(kind == "guano", key.rlike(r"^[^:\n]+\z") & (key != "GUANO|Version"))
    )
    return F.coalesce(allowed, F.lit(False))


def frame_field(frame: Column, description: Column, value: Column) -> tuple[Column, Column]:
    """An ID3v2 frame's key and text: custom ones by description, comments and lyrics where they have one; a text
    frame's several values joined by semicolons."""
    custom, noted = frame.isin("TXXX", "WXXX"), frame.isin("COMM", "USLT")
    key = F.when(custom | (noted & (description != "")), F.concat(frame, F.lit(":"), description)).otherwise(frame)
    return key, F.when(frame.startswith("T"), F.replace(value, F.lit("\0"), F.lit("; "))).otherwise(value)


def bext_problem(name: Column, text: Column) -> Column:
    """Why a text doesn't fit into a Broadcast WAV field, with its lines ended as that keeps them; null where it does."""
    size, most = F.octet_length(crlf(text)), _named({k: str(v) for k, v in BEXT_BYTES.items()}, name).cast("int")
    return F.when(size > most, F.concat(name, F.lit(" holds "), most.cast("string"), F.lit(" bytes and has "), size.cast("string")))


def dates_of(fields: DataFrame, starts: DataFrame) -> DataFrame:
    """The dates (rec_id, kind, start, end) that fields (rec_id, ord, source, key, value) and starts (rec_id, date, seconds) name.

    source is a tag's kind, info or ixml. A start counts where its date reads as one. Where none does, iXML's own copy
    of it counts: the first that isn't blank. A recorder's comment counts too; what reads as no date is left out.
    """
    kind, key = F.lit(None).cast("string"), F.col("key")
    for source, name, what in DATES:
        same = F.lower(key) == name if source in ("vorbis", "ape") else key == {"icrd": "ICRD", "timestamp": "Timestamp", "year": "Year"}.get(name, name if source == "mp4" else name.upper())
        kind = F.when((F.col("source") == source) & same, what).otherwise(kind)
    comment = (F.col("source") == "info") & (key == "ICMT")
    once = lambda stamp: F.inline(F.array(stamp))  # start and end of a text that is read once, whatever filters and fields follow
    tagged = fields.withColumn("kind", F.when(comment, "recorded").otherwise(kind)).where("kind is not null")
    tagged = tagged.select("rec_id", "kind", once(parse_stamp(F.when(comment, recorder_date(F.col("value"))).otherwise(F.col("value")))))
    begun = starts.select("rec_id", F.floor(F.pmod("seconds", F.lit(86400.0))).alias("s"), once(parse_stamp(F.col("date"))))
    begun = begun.select("rec_id", F.date_trunc("day", "start").cast("timestamp_ntz").alias("day"), "s").where("day is not null")
    second = F.col("day") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("s", F.lit(0)).cast("decimal(18,6)"))
    begun = begun.select("rec_id", F.lit("recorded").alias("kind"), second.alias("start"), (second + F.expr("interval 1 second")).alias("end"))
    copy = fields.where("source = 'ixml' and trim(value) <> ''").join(begun.select("rec_id"), "rec_id", "left_anti")
    first = lambda name: F.min_by(F.when(key.endswith(name), F.trim("value")), F.when(key.endswith(name), F.col("ord")))
    copy = copy.groupBy("rec_id").agg(first("BWF_ORIGINATION_DATE").alias("date"), first("BWF_ORIGINATION_TIME").alias("time"))
    copy = copy.where("date is not null").select("rec_id", "date", once(parse_stamp(F.concat_ws(" ", "date", "time"))))
    whole = F.struct("start", "end")
    copy = copy.select("rec_id", F.lit("recorded").alias("kind"), once(F.when(F.col("start").isNotNull(), whole).otherwise(parse_stamp(F.col("date")))))
    return tagged.unionByName(begun).unionByName(copy).where("start is not null")


def fields_of(details: DataFrame, tags: DataFrame, markers: DataFrame) -> DataFrame:
    """Every text a file has, with where it is from: (rec_id, label, value) of details (rec_id, section, label, value),
    tags (rec_id, kind, title, key, value) and markers (rec_id, label, note), whose empty texts are left out."""
    among = lambda name, where: F.concat(name, F.lit(" ("), where, F.lit(")"))
    text = markers.select("rec_id", F.explode(F.array("label", "note")).alias("value")).where("value <> ''")
    return (
        details.select("rec_id", among(F.col("label"), F.col("section")).alias("label"), "value")
        .unionByName(tags.select("rec_id", among(label(F.col("kind"), F.col("key")), F.col("title")).alias("label"), "value"))
        .unionByName(text.select("rec_id", F.lit("Marker").alias("label"), "value"))
    )


def catalogued(files: DataFrame, fields: DataFrame, dates: DataFrame) -> DataFrame:
    """files (rec_id, ...) with what a search asks: `text`, all values a line each, and `dates`, (kind, start, end)."""
    text = fields.groupBy("rec_id").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("text"))
    when = dates.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("dates"))
    return files.join(text, "rec_id", "left").join(when, "rec_id", "left")
