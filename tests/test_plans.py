"""Renames and conversions on small listings."""

import pytest
from pyspark.sql import functions as F

from sonoframe.plans import convert as V
from sonoframe.plans import rename as R


def files(spark, names, **more):
    rows = [("b", i, more.get("folder", "/x"), n, n not in more.get("unchosen", ()), more.get("recorded")) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "batch string, place long, folder string, name string, chosen boolean, recorded timestamp_ntz")


def new(spark, names, rules, **more):
    return [r["new_name"] for r in R.plan(files(spark, names, **more), rules).orderBy("place").collect()]


@pytest.mark.parametrize(
    ("rules", "before", "after"),
    [
        (R.Rules(pattern=r"^(\d+)_(\w+)$", replacement=r"\2-\1"), "0714_heron.wav", "heron-0714.wav"),
        (R.Rules(pattern="a", replacement=r"\9$"), "banana.wav", "b$n$n$.wav"),
        (R.Rules(name="reverse"), "abc.wav", "cba.wav"),
        (R.Rules(name="fixed", fixed="take"), "abc.wav", "take.wav"),
        (R.Rules(find="ZOOM", put="Field", any_case=True), "zoom0001.WAV", "Field0001.WAV"),
        (R.Rules(case="title", spelled=("BWF",)), "dawn CHORUS bwf.wav", "Dawn Chorus BWF.wav"),
        (R.Rules(case="sentence"), "DAWN chorus.wav", "Dawn chorus.wav"),
        (R.Rules(first=2, last=1, digits=True, accents=True, double_spaces=True, trim=True), "xxJõe  laht 12 z.wav", "Joe laht.wav"),
        (R.Rules(crop=("before", "DAWN")), "x dawn chorus.wav", "dawn chorus.wav"),
        (R.Rules(move=("first", 4, "end", "_")), "0714heron.wav", "heron_0714.wav"),
        (R.Rules(move=("first", 9, "end", "_")), "abc.wav", "_abc.wav"),
        (R.Rules(move=("copy first", 2, "end", "-")), "abc.wav", "abc-ab.wav"),
        (R.Rules(move=("copy last", 2, 2, "-")), "abc.wav", "a-bc-bc.wav"),
        (R.Rules(move=("last", 1, 99, "-")), "abc.wav", "ab-c-.wav"),
        (R.Rules(lead_dots=True, trim=True), " ..a .wav", "a.wav"),
        (R.Rules(accents=True), "ŁódźØĿÆß.wav", "LodzOLÆß.wav"),
        (R.Rules(extension="extra", fixed_extension="..bak"), "a.WAV", "a.WAV.bak"),
        (R.Rules(extension="extra", fixed_extension=".bak"), "a", "a.bak"),
        (R.Rules(extension="title"), "a.WAV", "a.Wav"),
        (R.Rules(number=("both", 1, 1, 2, "_")), "a.wav", "01_a_01.wav"),
        (R.Rules(number=(2, 1, 1, 2, "_")), "abc.wav", "a01bc.wav"),
        (R.Rules(extension="lower"), "A.WAV", "A.wav"),
        (R.Rules(symbols=True), "take_one-two\t(é).wav", "take_one-twoé.wav"),
        (R.Rules(cut=(5, 2)), "abcdefgh.wav", "abcdefgh.wav"),
        (R.Rules(cut=(2, 3)), "abcdefgh.wav", "adefgh.wav"),
        (R.Rules(cut=(9, 12)), "abcdefgh.wav", "abcdefgh.wav"),
        (R.Rules(insert_number=(1, -3, 1, 5)), "a.wav", "-0003a.wav"),
        (R.Rules(number=("prefix", 28, 1, 0, "_"), numerals="upper"), "a.wav", "AB_a.wav"),
        (R.Rules(number=("prefix", -4, 1, 3, "_"), numerals="roman"), "a.wav", "-IV_a.wav"),
        (R.Rules(pattern=r"(?<day>\d+)(?:x)([a-z)]+)", replacement=r"\2\1"), "12xab.wav", "ab12.wav"),
        (R.Rules(prefix="EE_", word_space=True, insert=("-", 5), suffix="_A"), "DawnChorus.wav", "EE_Dawn- Chorus_A.wav"),
    ],
)
def test_rules(spark, rules, before, after):
    assert new(spark, [before], rules) == [after]


def test_numbers_skip_unchosen_files(spark):
    rules = R.Rules(number=("prefix", 1, 1, 3, "_"))
    assert new(spark, ["a.wav", "b.wav", "c.wav"], rules, unchosen=("b.wav",)) == ["001_a.wav", "002_c.wav"]
    assert new(spark, ["a.wav", "b.wav"], R.Rules(number=("prefix", 9, 1, 0, "_"), numerals="roman")) == ["IX_a.wav", "X_b.wav"]


def test_insert_number(spark):
    assert new(spark, ["a1.wav", "b2.wav", "c3.wav"], R.Rules(insert_number=(2, 7, 5, 2))) == ["a071.wav", "b122.wav", "c173.wav"]


def test_collisions(spark):
    problems = lambda names, rules, **more: [r["problem"] for r in R.plan(files(spark, names, **more), rules).orderBy("place").collect()]
    fixed = R.Rules(name="fixed", fixed="keep")
    assert problems(["keep.wav", "a.wav"], fixed, unchosen=("keep.wav",)) == ["exists"]
    assert problems(["keep.wav", "a.wav", "b.wav"], fixed, unchosen=("keep.wav",)) == ["duplicate", "duplicate"]
    assert problems(["a.wav", "b.wav"], R.Rules(pattern="^(a|b)$", replacement="x$1")) == [None, None]
    assert problems(["a.wav"], R.Rules(date=("prefix", "%Y", "_"))) == ["no date"]
    assert problems(["a.wav"], R.Rules(date=("prefix", "%Q", "_"))) == problems(["a.wav"], R.Rules(pattern="[")) == ["rules"]


def test_free_names_meet_other_stems(spark):
    wanted = spark.createDataFrame([("f", 0, "a", "wav"), ("f", 1, "a 2", "wav"), ("f", 2, "a", "wav")], "folder string, place long, stem string, ext string")
    taken = spark.createDataFrame([("f", "A.WAV")], "folder string, name string")
    assert [r["name"] for r in V.free_names(wanted, taken).orderBy("place").collect()] == ["a 2.wav", "a 2 2.wav", "a 3.wav"]


def test_shapes(spark):
    rows = spark.createDataFrame([("flac", 44100, 2, "int", 16, 48000, "as file"), ("mp3", 96000, 2, "int", 16, 96000, "as file"), ("flac", 705600, 1, "int", 16, None, "as file")], "format string, rate long, channels long, coding string, bits long, wanted_rate long, wanted_depth string")
    a, b, e = V.shape(rows).collect()
    assert a["changes"] == ["48 kHz from 44.1 kHz"] and b["to_rate"] == 48000
    assert e["error"] == "FLAC keeps rates up to 655.35 kHz; this file is 705.6 kHz: pick a lower rate, or WAV, CAF or M4A keep it"
    schema = "format string, rate long, channels long, coding string, bits long, wanted_rate long, wanted_depth string, features array<string>, markers int"
    rows = spark.createDataFrame([("mp3", 44100, 2, "int", 24, 96000, "as file", [], 0), ("mka", 705600, 1, "int", 16, None, "as file", [], 0), ("webm", 192000, 2, "lossy", None, None, "16", ["notes", "pictures"], 3), ("m4a", 48000, 2, "float", 32, None, "as file", ["lengths", "notes"], 300), ("mp3", 8000, 6, "int", 16, None, "16", [], 0), ("caf", 8000, 1, "int", 8, 16000, "as file", ["lengths"], 1), ("flac", 88200, 2, "lossy", None, 88200, "as file", ["pictures"], 0)], schema)
    found = [(r["to_rate"], r["to_bits"], r["error"], r["changes"]) for r in V.shape(rows).collect()]
    assert found[0][0] == 48000 and found[0][3] == ["48 kHz from 44.1 kHz (MP3 keeps 8 to 48 kHz, in steps)"]
    assert "pick a lower rate" in found[1][2] and found[4][2] == "MP3 holds at most 2 channels; this file has 6"
    assert found[2] == (192000, None, None, ["encoded again from a lossy file", "WebM (Vorbis) has no place for its pictures", "its markers' notes have no place in WebM (Vorbis)"])
    assert found[3] == (48000, 24, None, ["24-bit from 32-bit float", "its markers' lengths and notes have no place in M4A (ALAC)", "M4A keeps its first 255 markers"])
    assert found[5] == (16000, 16, None, ["16 kHz from 8 kHz", "16-bit from 8-bit", "its markers' lengths have no place in CAF"]) and found[6] == (88200, 16, None, ["16-bit"])


def test_hash_depends_on_order(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.2, 0.1])], "rec_id long, samples array<double>")
    assert V.sample_hash(rows).select(F.count_distinct("digest")).first()[0] == 2


def test_markers_and_regions(spark):
    from pyspark.sql import functions as F

    from sonoframe.operators import markers as M

    rows = spark.createDataFrame([(1, 10, 30, 5), (2, None, None, 7), (3, None, None, None), (4, 30, 10, 5)], "id int, start long, end long, cursor long")
    frame, length = M.marker_from_selection(F.col("start"), F.col("end"), F.col("cursor"))
    assert [tuple(r) for r in rows.orderBy("id").select(frame, length).collect()] == [(10, 20), (7, 0), (0, 0), (30, 0)]
    drawn = M.drawn_region(*[F.lit(x) for x in (90, 9000.0, 10, 100.0)], F.lit(8000.0), F.lit(False))
    assert tuple(spark.range(1).select(*drawn).first()) == (10, 90, 100.0, 8000.0)
    tracks = spark.createDataFrame([(1, 1, 1, "left"), (1, 2, 1, " Boom "), (1, 3, 1, "  "), (1, 4, 9, "far"), (1, 5, None, "none"), (1, 6, 2, None)], "rec_id int, ord int, channel_index int, name string")
    channels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "rec_id int, channel int")
    assert sorted((tuple(r) for r in M.track_names(tracks, channels).collect()), key=str) == [(1, 0, "Boom"), (1, 1, None), (2, 0, None)]
    jobs = spark.createDataFrame([(1, True, None), (1, False, 0.5), (1, False, None), (1, True, 0.25)], "batch_id int, finished boolean, partial double")
    assert tuple(M.batch_progress(jobs).first()) == (1, 2, 4, 0.625)
    assert M.batch_progress(jobs.limit(0)).count() == 0


def test_free_names_without_taken_ones(spark):
    wanted = spark.createDataFrame([("f", 0, "a", "wav"), ("g", 1, "A", "wav"), ("g", 2, "a", "WAV")], "folder string, place long, stem string, ext string")
    none = spark.createDataFrame([], "folder string, name string")
    assert sorted(r["name"] for r in V.free_names(wanted, none).collect()) == ["A.wav", "a 2.WAV", "a.wav"]
    assert V.free_names(wanted.limit(0), none).collect() == []


def test_verified(spark):
    kind = "rec_id int, format string, rate int, channels int, frames long, hash string"
    written = spark.createDataFrame([(1, "wav", 48000, 2, 10, "x"), (2, "mp3", 48000, 2, 10, None), (3, "ogg", 48000, 2, 10, None), (4, None, 48000, 2, 10, "x")], kind)
    read = spark.createDataFrame([(1, "", 48000, 2, 10, None), (2, "", 48000, 2, 3419, None), (3, "", 48000, 2, 11, None)], kind).drop("format")
    assert {r["rec_id"]: r["problem"] for r in V.verified(written, read).collect()} == {1: "audio", 2: None, 3: "length", 4: "unreadable"}


def test_carry_problems(spark):
    files = spark.createDataFrame([(i, f, 48000) for i, f in enumerate(("wav", "caf", "m4a", "wav", "wav", "caf", "webm", "m4a", "wav", "wav"))] + [(10, None, None)], "rec_id long, format string, rate int")
    fields = spark.createDataFrame([(0, 2, "B", None, "b"), (0, 1, "A", None, "a"), (1, 1, "A", None, "a"), (1, 2, "T", "TRACKNUMBER", " 03"), (3, 1, "A", None, None), (4, 1, "A", None, "a"), (5, 1, "A", None, "x; y"), (99, 1, "A", None, "lost"), (None, 1, "A", None, "lost")], "rec_id long, ord int, key string, name string, value string")
    read = spark.createDataFrame([(0, "A", None, "a; b"), (1, "all", None, "a; 3"), (3, "A", None, ""), (4, "A", None, "a"), (4, "A", None, "a"), (5, "A", None, "y; x; y")], "rec_id long, key string, name string, value string")
    pictures = spark.createDataFrame([(4, 2, "back", b"2"), (4, 1, "front", b"1"), (6, 1, "front", b"1"), (1, 1, "front", b"1"), (3, 1, "front", None)], "rec_id long, ord int, kind string, content binary")
    shown = spark.createDataFrame([(4, b"2"), (4, b"2"), (3, None)], "rec_id long, content binary")
    marks = [(2, i, i * 10, f"m{i}") for i in range(300)] + [(7, i, i * 100, f"m{i}") for i in range(300)] + [(8, 1, 5, "a"), (8, 2, 5, "b"), (8, 3, 900, None), (9, 1, 1, "a"), (9, 2, 100, "b"), (9, 3, 200, "c"), (10, 1, 10, "a")]
    now = [(2, i, i * 10, f"m{i}") for i in range(255)] + [(7, i, i * 100 + 48, f"m{i}") for i in range(254)] + [(7, 254, 25400, "x")] + [(8, 1, 5, "b"), (8, 2, 5, "a"), (8, 3, 900, None), (9, 1, 0, "a"), (9, 2, 149, "b"), (9, 3, 200, "x"), (10, 1, 11, "a")]
    kind = "rec_id long, id int, frame long, label string"
    got = V.carry_problems(files, fields, pictures, spark.createDataFrame(marks, kind), read, shown, spark.createDataFrame(now, kind))
    assert {r["rec_id"]: r["problem"] for r in got.collect()} == {
        0: "tag A is missing", 1: None, 2: None, 3: None, 4: "front picture is missing", 5: "tag A is missing", 6: None, 7: 'marker "m254" moved or lost its name',
        8: 'marker "a" moved or lost its name', 9: 'marker "b" moved or lost its name', 10: 'marker "a" moved or lost its name',
    }
    assert V.carry_problems(files, fields, pictures, spark.createDataFrame(marks, kind), read, shown, spark.createDataFrame(now[1:], kind)).where("rec_id = 2").first()["problem"] == "254 markers came back of 255"


def test_carry_problems_deals_rows_by_file_once(spark, sf):
    from sonoframe.queries import convert as Q

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.carry_problems(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning(rec_id") == plan.count("Exchange ") <= 9
