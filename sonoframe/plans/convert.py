"""Conversions: what shape a file takes in a format, whether it has to be scanned and turned down, and its new name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N

#: The most channels that a format holds.
MOST_CHANNELS = {"wav": 65535, "aiff": 65535, "caf": 65535, "flac": 8, "m4a": 8, "mka": 8, "mp3": 2, "ogg": 255, "webm": 255}
LOSSY = ("mp3", "ogg", "webm")
#: The names of formats, and what a format can't hold.
NAMES = {"wav": "WAV", "aiff": "AIFF", "caf": "CAF", "flac": "FLAC", "m4a": "M4A (ALAC)", "mka": "MKA (FLAC)", "mp3": "MP3", "ogg": "Ogg Vorbis", "webm": "WebM (Vorbis)"}
LACKS = {"m4a": ("lengths", "notes"), "caf": ("lengths", "notes", "pictures"), "mka": ("notes",), "webm": ("notes", "pictures")}
#: The highest rate of FLAC, and how many markers M4A keeps.
FLAC_MOST, M4A_MARKERS = 655350, 255


def _by(format_: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(format_ == k, F.lit(v)).otherwise(out)
    return out


def shape(files: DataFrame) -> DataFrame:
    """Of files (format, rate, channels, coding, bits; wanted_rate, wanted_depth): the new rate and bits, or an error.

    coding is int, float or lossy; wanted_depth is as file, 16, 24 or float. changes says what differs, in order; columns
    features (array of lengths, notes, pictures) and markers (how many), where files has them, add what gets lost.
    """
    f, name = F.col("format"), _by(F.col("format"), NAMES)
    lossy, vorbis = f.isin(*LOSSY), f.isin("ogg", "webm")
    asked = F.coalesce("wanted_rate", "rate")
    rate = F.when(f == "mp3", N.mp3_rate(asked)).when(vorbis, N.vorbis_rate(asked)).otherwise(asked)
    float_ = f.isin("wav", "aiff", "caf")
    own = F.when(F.col("coding") == "int", F.col("bits")).when(F.col("coding") == "float", F.when(float_, 32).otherwise(24)).otherwise(16)
    depth = F.when(F.col("wanted_depth") == "16", 16).when(F.col("wanted_depth") == "24", 24).when(F.col("wanted_depth") == "float", F.when(float_, 32).otherwise(24)).otherwise(own)
    is_float = float_ & ((F.col("wanted_depth") == "float") | ((F.col("wanted_depth") == "as file") & (F.col("coding") == "float")))
    steps = F.when(depth <= 16, 16).when(depth <= 20, 20).when(depth <= 24, 24).otherwise(32)
    whole = F.least(F.greatest(F.ceil(depth / 8) * 8, F.when(f == "caf", 16).otherwise(8)), F.lit(32))
    bits = F.when(lossy | is_float, F.lit(None)).when(f == "m4a", steps).when(f.isin("flac", "mka"), F.greatest(F.lit(4), F.least(depth, F.lit(32)))).otherwise(whole)
    most = _by(f, MOST_CHANNELS)
    crowded = F.concat(name, F.lit(" holds at most "), most.cast("string"), F.lit(" channels; this file has "), F.col("channels").cast("string"))
    fast = F.concat(F.lit("FLAC keeps rates up to 655.35 kHz; this file is "), N.khz_text(asked), F.lit(": pick a lower rate, or WAV, CAF or M4A keep it"))
    error = F.when(F.col("channels") > most, crowded).when(f.isin("flac", "mka") & (asked > FLAC_MOST), fast)
    rows = files.withColumn("to_rate", rate.cast("long")).withColumn("to_bits", bits.cast("long")).withColumn("to_float", lossy | is_float).withColumn("error", error)
    why = F.when(F.col("to_rate") == asked, "").when(f == "mp3", " (MP3 keeps 8 to 48 kHz, in steps)").when(vorbis, " (Vorbis keeps up to 200 kHz)").otherwise("")
    said = F.when(F.col("to_rate") != F.col("rate"), F.concat(N.khz_text(F.col("to_rate")), F.lit(" from "), N.khz_text(F.col("rate")), why))
    was = F.when(F.col("coding") == "int", F.concat(F.col("bits").cast("string"), F.lit("-bit"))).when(F.col("coding") == "float", "32-bit float")
    now = F.when(F.col("to_float"), "32-bit float").otherwise(F.concat(F.col("to_bits").cast("string"), F.lit("-bit")))
    deep = F.when(~lossy, F.when(was.isNull(), now).when(was != now, F.concat(now, F.lit(" from "), was)))
    again = F.when(lossy & (F.col("coding") == "lossy"), "encoded again from a lossy file")
    changes = [said, deep, again]
    if "features" in files.columns:
        gone = lost(f, F.col("features"))
        marks = F.filter(F.array(F.lit("lengths"), F.lit("notes")), lambda x: F.array_contains(gone, x))
        changes.append(F.when(F.array_contains(gone, "pictures"), F.concat(name, F.lit(" has no place for its pictures"))))
        changes.append(F.when(F.size(marks) > 0, F.concat(F.lit("its markers' "), F.array_join(marks, " and "), F.lit(" have no place in "), name)))
    if "markers" in files.columns:
        changes.append(F.when((f == "m4a") & (F.col("markers") > M4A_MARKERS), f"M4A keeps its first {M4A_MARKERS} markers"))
    return rows.withColumn("changes", F.array_compact(F.array(*changes)))


def needs_peak(shaped: DataFrame) -> Column:
    """Only a target of whole numbers can be overdriven, by a source that isn't or by a new rate."""
    return ~F.col("to_float") & ((F.col("coding") != "int") | (F.col("to_rate") != F.col("rate")))


def lost(format_: Column, has: Column) -> Column:
    """Of the features that a file has, those that a format can't hold."""
    kept = F.array().cast("array<string>")
    for k, v in LACKS.items():
        kept = F.when(format_ == k, F.array(*map(F.lit, v)).cast("array<string>")).otherwise(kept)
    return F.array_intersect(has, kept)


def carried(markers: DataFrame, rate: str, to: str) -> DataFrame:
    """Markers at a new rate: positions and lengths rounded down."""
    move = lambda x: N.rescaled(F.col(x), F.col(rate), F.col(to))
    return markers.withColumn("frame", move("frame")).withColumn("length", move("length"))


def lost_markers(before: DataFrame, after: DataFrame, rate: int) -> DataFrame:
    """Markers without one of the same label within a millisecond in the written file."""
    near = (F.abs(F.col("b.frame") - F.col("a.frame")) * 1000 <= rate) & (F.col("a.rec_id") == F.col("b.rec_id")) & F.col("a.label").eqNullSafe(F.col("b.label"))
    return before.alias("b").join(after.alias("a"), near, "left_anti")


def carry_problems(files: DataFrame, fields: DataFrame, pictures: DataFrame, markers: DataFrame, read_fields: DataFrame, read_pictures: DataFrame, read_markers: DataFrame) -> DataFrame:
    """What a written file lacks of what it should hold: rec_id and problem (null where it holds all) of files (rec_id, format, rate).

    fields: (rec_id, ord, key, name, value), name the known name, if any; pictures: (rec_id, ord, kind, content); markers:
    (rec_id, id, frame, label). The first that holds: a field whose value isn't among those read (numbers without leading
    zeros; CAF keeps several values as one), a picture in a format that keeps them, another count of markers (M4A
    keeps the first 255), a marker that is more than a millisecond away from its place or has lost its name.

    Defined results: rows of files that aren't in `files` are ignored, nulls are values like others, repeated values need be read once.

    Rows are dealt by file, once; there, what is wanted and what was read meet in groups of equal values or places.
    """
    number = F.col("name").isin("TRACKNUMBER", "TRACKTOTAL", "DISCNUMBER", "DISCTOTAL") & F.col("value").rlike(r"^\s*[0-9]+\s*$")
    value = F.when(F.coalesce(number, F.lit(False)), F.regexp_replace(F.trim("value"), "^0+", "")).otherwise(F.coalesce("value", F.lit("")))
    dealt = lambda df: df.where("rec_id is not null").repartition("rec_id")
    at = lambda name: F.when(F.col("ord").isNotNull(), F.struct("ord", F.col(name).alias("what"))).alias("at")
    # found: 0 not at all, 1 as a part of a value, which counts in CAF, 2 as a value
    parts = F.when(F.contains("v", F.lit("; ")), F.concat(F.array("v"), F.split("v", "; "))).otherwise(F.array("v"))
    back = read_fields.select("rec_id", value.alias("v")).select("rec_id", F.posexplode(parts).alias("n", "v")).select("rec_id", "v", F.when(F.col("n") == 0, 2).otherwise(1).alias("found"))
    values = dealt(fields.select("rec_id", value.alias("v"), F.lit(0).alias("found"), at("key")).unionByName(back, allowMissingColumns=True))
    values = values.groupBy("rec_id", "v").agg(F.min("at").alias("at"), F.max("found").alias("found")).where("found < 2 and at is not null")
    gone = values.groupBy("rec_id").agg(F.min(F.when(F.col("found") == 0, F.col("at"))).alias("gone"), F.min("at").alias("not_whole"))
    seen = pictures.select("rec_id", "content", F.lit(0).alias("found"), at("kind")).unionByName(read_pictures.select("rec_id", "content", F.lit(1).alias("found")), allowMissingColumns=True)
    seen = dealt(seen).groupBy("rec_id", "content").agg(F.min("at").alias("at"), F.max("found").alias("found")).where("found = 0 and at is not null")
    unseen = seen.groupBy("rec_id").agg(F.min("at").alias("unseen"))
    both = dealt(markers.select("rec_id", F.lit(0).alias("side"), "frame", "id", "label").unionByName(read_markers.select("rec_id", F.lit(1).alias("side"), "frame", "id", "label")))
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("rec_id", "side").orderBy("frame", "id")))
    listed = files.select("rec_id", "format", "rate").repartition("rec_id")
    counted = (F.col("side") == 1) | (F.col("format") != "m4a") | (F.col("place") <= M4A_MARKERS)
    frame = lambda n: F.max(F.when(F.col("side") == n, F.col("frame")))
    # places have no gaps, so where counts are equal each wanted one has its other: by its name, or it has lost it
    named = placed.join(listed, "rec_id").where(counted).groupBy("rec_id", "place", "label").agg(F.count_if(F.col("side") == 0).alias("was"), F.count_if(F.col("side") == 1).alias("now"), (F.abs(frame(1) - frame(0)) * 1000 > F.max(F.greatest("rate", F.lit(1)))).alias("far"))
    named = named.withColumn("bad", (F.col("was") > 0) & ((F.col("now") == 0) | F.coalesce("far", F.lit(False))))
    marks = named.groupBy("rec_id", "bad", F.when(F.col("bad"), F.col("label")).alias("label")).agg(F.sum("was").alias("was"), F.sum("now").alias("now"), F.min("place").alias("place"))
    marks = marks.groupBy("rec_id").agg(F.sum("was").alias("n_wanted"), F.sum("now").alias("n_found"), F.min(F.when(F.col("bad"), F.struct("place", "label"))).alias("astray"))
    rows = listed
    for more in (gone, unseen, marks):
        rows = rows.join(more, "rec_id", "left")
    key = F.when(F.col("format") == "caf", F.col("gone.what")).otherwise(F.col("not_whole.what"))
    picture = F.when(~F.array_contains(lost(F.col("format"), F.array(F.lit("pictures"))), "pictures"), F.col("unseen.what"))
    n_found, n_wanted = F.coalesce("n_found", F.lit(0)), F.coalesce("n_wanted", F.lit(0))
    problem = (
        F.when(key.isNotNull(), F.concat(F.lit("tag "), key, F.lit(" is missing"))).when(picture.isNotNull(), F.concat(picture, F.lit(" picture is missing")))
        .when(n_found != n_wanted, F.concat(n_found.cast("string"), F.lit(" markers came back of "), n_wanted.cast("string")))
        .when(F.col("astray").isNotNull(), F.concat(F.lit('marker "'), F.coalesce("astray.label", F.lit("")), F.lit('" moved or lost its name')))
    )
    return rows.select("rec_id", problem.alias("problem"))


#: The frames that a lossy format's decoder may give beyond those written.
SLACK = {"mp3": 2 * 1152 + 1105, "webm": 4096}


def verified(written: DataFrame, read: DataFrame) -> DataFrame:
    """What is wrong with written files (rec_id, format, rate, channels, frames, hash) as read back (the same but format).

    problem is unreadable (no row in read, or a null in it), format, audio (frames or hash of a file that has a hash),
    length (of one that has none: fewer frames, or more than its decoder may give), or null. A row a row of written.
    """
    names = ["rate", "channels", "frames", "hash"]
    both = written.join(read.select("rec_id", *[F.col(n).alias(f"now_{n}") for n in names]), "rec_id", "left")
    now = {n: F.col(f"now_{n}") for n in names}
    more = now["frames"] - F.col("frames")
    problem = (
        F.when(now["rate"].isNull() | now["channels"].isNull() | now["frames"].isNull(), "unreadable")
        .when((now["rate"] != F.col("rate")) | (now["channels"] != F.col("channels")), "format")
        .when(F.col("hash").isNotNull(), F.when((more != 0) | ~now["hash"].eqNullSafe(F.col("hash")), "audio"))
        .when((more < 0) | (more > F.coalesce(_by(F.col("format"), SLACK), F.lit(0))), "length")
    )
    return both.select("rec_id", problem.alias("problem"))


def free_names(wanted: DataFrame, taken: DataFrame, folder: str = "folder") -> DataFrame:
    """Of wanted (folder, place, stem, ext): names in order of place that neither a taken file nor an earlier one has.

    `stem.ext`, then `stem 2.ext` and so on, compared in lower case. Each choice depends on those before, also of other
    stems, so a folder's rows pass one task in order, batch by batch; it holds the folder's names, not its rows. Folders
    without taken names, and empty tables, are fine; a null stem or extension counts as empty.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, again = None, set(), {}
        for batch in batches:
            folders, places, names = [], [], []
            for at, place, stem, ext, has in zip(*(batch.column(c).to_pylist() for c in ("folder", "place", "stem", "ext", "name"))):
                if at != current:
                    current, used, again = at, set(), {}
                if place is None:
                    used.add(has.lower())
                    continue
                key = stem.lower(), ext.lower()
                n = again.get(key, 1)
                while (made := f"{stem}.{ext}" if n == 1 else f"{stem} {n}.{ext}").lower() in used:
                    n += 1
                again[key] = n + 1
                used.add(made.lower())
                folders.append(at), places.append(place), names.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(places, pa.int64()), pa.array(names, pa.string())], ["folder", "place", "name"])

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = wanted.select(F.col(folder).alias("folder"), F.col("place").cast("long").alias("place"), text("stem"), text("ext"), none("name", "string"))
    held = taken.where("name is not null").select(F.col(folder).alias("folder"), none("place", "long"), none("stem", "string"), none("ext", "string"), "name")
    rows = asked.unionByName(held).repartition("folder").sortWithinPartitions("folder", F.col("place").asc_nulls_first())
    return rows.mapInArrow(name, "folder string, place long, name string")


def sample_hash(recordings: DataFrame) -> DataFrame:
    """An order-sensitive hash of each recording's samples as 32-bit floats: rotate by 5, xor, multiply, modulo 2^64."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for samples in pdf.samples:
                h = 0xCBF29CE484222325
                for bits in np.asarray(samples, dtype=np.float32).view(np.uint32).tolist():
                    h = (((h << 5 | h >> 59) & 0xFFFFFFFFFFFFFFFF) ^ bits) * 0x517CC1B727220A95 & 0xFFFFFFFFFFFFFFFF
                out.append(f"{h:016x}")
            yield pd.DataFrame({"rec_id": pdf.rec_id, "digest": out})

    return recordings.select("rec_id", "samples").mapInPandas(work, "rec_id long, digest string")
