"""Text and number rules on small tables of inputs and outputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import metadata as M
from sonoframe.functions import numbers as N
from sonoframe.functions import text as T
from sonoframe.functions.order import natural_key


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def many(spark, column, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", column(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_stamps(spark):
    s = lambda *x: dt.datetime(*x)
    cases = {
        "2024-05-01T21:30:05.250+02:00": (s(2024, 5, 1, 21, 30, 5), s(2024, 5, 1, 21, 30, 6)), "2024-05-01T21:30": (s(2024, 5, 1, 21, 30), s(2024, 5, 1, 21, 31)),
        "2024:05:01": (s(2024, 5, 1), s(2024, 5, 2)), "2024-02": (s(2024, 2, 1), s(2024, 3, 1)), "2024": (s(2024, 1, 1), s(2025, 1, 1)), "1.5.2024": (s(2024, 5, 1), s(2024, 5, 2)),
        "2024-05-01T": (s(2024, 5, 1), s(2024, 5, 2)), "2024-05-01 21": (s(2024, 5, 1, 21), s(2024, 5, 1, 22)),
        "": (None, None), "May": (None, None), "2024-13-01": (None, None), "24-05-01": (None, None), "2024-05-01 25:00": (None, None), "2024 21:00": (None, None),
    }
    assert [tuple(r) for r in many(spark, T.parse_stamp, list(cases))] == list(cases.values())


def test_lengths_and_frequencies(spark):
    assert many(spark, T.parse_length, ["90", "1:30", "1:02:03", "2 m", "2min", "1,5 h", "45s", "long", "-3", "", None]) == [90, 90, 3723, 120, 120, 5400, 45, None, None, None, None]
    assert many(spark, T.parse_hz, ["12000", "12k", " 12.5 kHz ", "440 Hz", "1,5k", "1 MHz", "0.5m", "loud", "-3"]) == [12000, 12000, 12500, 440, 1500, 1e6, 5e5, None, None]
    assert many(spark, N.hz_text, [440.0, 2500.0, 192000.0, 1e6, 1.25e6], "double") == ["440", "2.5k", "192k", "1M", "1.25M"]
    assert many(spark, N.hz_field, [12345.0, 440.0, 1e6, 999.6, 2500.0, 12000.0, 1.2345e6, None], "double") == ["12.3 kHz", "440 Hz", "1 MHz", "1000 Hz", "2.50 kHz", "12.0 kHz", "1.234 MHz", None]
    assert many(spark, N.hz_exact, [440.0, 2500.0, 12345.6], "double") == ["440.0 Hz", "2.500 kHz", "12.35 kHz"]
    assert many(spark, N.hz_field, [8915.0, 9995.0, 8005.0, 2125.0], "double") == ["8.91 kHz", "9.99 kHz", "8.01 kHz", "2.12 kHz"]  # 8.915 * 100 is under 891.5
    assert many(spark, N.hz_exact, [545565.0, 307655.0, 8154.5], "double") == ["545.57 kHz", "307.65 kHz", "8.155 kHz"]
    assert many(spark, N.speed_text, [0.125, 1.0, 2.5, 1000.0, 0.3, 12345.0, 1 / 1000], "double") == ["1/8×", "1×", "2.5×", "1000×", "0.3×", "12345×", "1/1000×"]
    assert many(spark, N.parse_speed, ["2", "×2.5×", " 1 / 8 x", "1/0", "0", "inf", "fast", None]) == [2, 2.5, 0.125, None, None, None, None, None]
    assert many(spark, lambda x: N.clock(x, 2), [59.994, 59.996, -3.0, 3725.5], "double") == ["0:59.99", "1:00.00", "0:00.00", "1:02:05.50"]
    assert many(spark, lambda x: N.wall(x, 3), [86399.9996, 61454.0 + 86400, -1.0], "double") == ["00:00:00.000", "17:04:14.000", "23:59:59.000"]
    assert many(spark, lambda x: N.nearest_bin(x, F.lit(23.4375), 1025), [24000.0, 24005.0, 11.0, 12.0], "double") == [1024, None, 0, 1]
    assert many(spark, lambda x: N.unpacked(N.packed(x, F.lit(7).cast("long")))[0], [0, 7, 32768, 40000, 65535, 65536], "long") == [0, 7, 32768, 40000, 65535, 0]
    assert many(spark, lambda x: T.number_split(x)[1], ["3/12", " 3 / 12 ", "AC/DC", "3/", "/3", "1/2/3", "٣/4"]) == ["12", "12", None, None, None, None, None]
    assert many(spark, T.name_problem, ["a", "a\u0085", "\u00a0a", "\u2003", "a\u009bb", "a/b", ".a"]) == [None, "edge space", "edge space", "empty", "reserved", "reserved", "leading dot"]
    assert many(spark, T.parse_length, ["1:30.5", "2 hours", "3 sec", "1:-2", "1::2", ".5h", "1e2", " 1 : 2 ", "min"]) == [90.5, None, None, None, None, 1800, 100, 62, None]
    assert many(spark, N.clock_seconds, ["25:61:99", "21:30:05.5", "21-30.05", " 1 : 2 : 3 ", "21:30", "", None]) == [None, 77405, 77405, 3723, None, None, None]
    assert many(spark, N.mp3_rate, [88200, 176400, 96000, 44100, 5000, 48001], "long") == [44100, 44100, 48000, 44100, 8000, 48000]
    assert many(spark, lambda x: N.lifted(x, F.lit(6.0)), [-100.0, -103.0, -99.0, -20.0, -200.0], "double") == [-100, -100, -93, -14, -100]
    assert many(spark, T.human_text, ["sA=1\r one\t\n\u2003two ", "zTRK1=x", "\r\n", None]) == ["one two", None, None, None]
    assert many(spark, N.clock, [364, 3725], "long") == ["6:04", "1:02:05"]
    assert one(spark, N.wall, 61454 + 86400, "long") == "17:04:14"


def test_words():
    assert T.query_words('Heron "dawn chorus"  *.WAV') == ["heron", "dawn chorus", ".wav"]
    assert T.query_words('open "to the end') == ["open", "to the end"]
    assert T.query_words('ab"cd ef" "  " " x" ""') == ['ab"cd', 'ef"', " x"]
    assert T.query_words('**.wav * "*a b"') == [".wav", "a b"]


def test_words_of_a_column(spark):
    asks = ['Heron "dawn chorus"  *.WAV', 'open "to the end', 'ab"cd ef" "  " " x" ""', '**.wav * "*a b"', "", None]
    assert many(spark, T.words_of, asks) == [T.query_words(x) if x is not None else None for x in asks]


def test_picture_sizes(spark):
    from sonoframe.operators import fields as D

    cases = [(4000, 2048, 1025, 1.0, 1), (480_000, 2048, 1025, 1.0, 1), (60 * 48_000, 2048, 1025, 1.0, 1), (60 * 48_000, 8192, 4097, 1.0, 1), (60 * 48_000, 2048, 90, 1.0, 1), (48_000, 2048, 1025, 0.5, 1), (48_000, 2048, 1025, 0.001, 1), (48_000, 2048, 0, 0.0, 1)]
    want = [(4000, 2048), (4096, 2048), (5625, 2048), (None, 4097), (None, 2048), (None, 4096), (None, 8192), (None, 2048)]
    for (n, fft, bins, share, lanes), (columns, rows) in zip(cases, want):
        got = tuple(spark.range(1).select(*D.picture_size(F.lit(n), fft, F.lit(bins), F.lit(share), F.lit(lanes))).first())
        assert got[1] == rows and columns in (None, got[0])
    columns, rows = spark.range(1).select(*D.picture_size(F.lit(3600 * 48_000), 8192, F.lit(4097), F.lit(1.0), F.lit(8))).first()
    assert columns * rows * 8 <= 64_000_000 and columns > 1000


def test_speakers():
    from sonoframe.operators.signal import speaker_gains

    assert speaker_gains(2, set(), True) == [(0, 1.0, 0.0), (1, 0.0, 1.0)]
    assert speaker_gains(2, {1}, True) == [(0, 1.0, 1.0), (1, 0.0, 0.0)] and speaker_gains(1, set(), False) == [(0, 1.0, 1.0)]
    assert speaker_gains(3, {0}, False) == [(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 0.5, 0.0)] and speaker_gains(2, {0, 1}, True) == [(0, 0.0, 0.0), (1, 0.0, 0.0)]


def test_natural_order(spark):
    names = ["take 10", "b", "a10", "10", "take 1", "010", "9", "a2", "take 9"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["9", "010", "10", "a2", "a10", "b", "take 1", "take 9", "take 10"]


@pytest.mark.parametrize(("mask", "name", "fits"), [("*.wav", "take 1.wav", True), ("take ?.wav", "take 7.wav", True), ("*", "", True), ("*.WAV; *.flac", "notes.txt", False), ("*.WAV; *.flac", "a.flac", True), ("a+b*", "a+bc", True)])
def test_masks(mask, name, fits):
    import re

    assert bool(re.match(T.mask_pattern(mask), name)) is fits


def test_names(spark):
    assert many(spark, T.letters, [0, 1, 26, 27, 702, 703], "long") == ["", "a", "z", "aa", "zz", "aaa"]
    assert many(spark, T.roman, [0, 4, 9, 1994], "long") == ["", "IV", "IX", "MCMXCIV"]
    assert many(spark, T.title_words, ["dawn CHORUS o'neil"]) == ["Dawn Chorus O'neil"]
    assert many(spark, T.name_problem, ["", " a", ".a", "a/b", "x" * 256, "ok.wav"]) == ["empty", "edge space", "leading dot", "reserved", "too long", None]
    assert many(spark, T.recorder_date, ["Recorded at 21:30:00 01/05/2024 (UTC+1) by it", "x", None]) == ["2024-05-01 21:30:00", None, None]


def test_xml():
    xml = "<A><B>1 &lt; 2</B><C><D>x<E>y</C></Z><F><![CDATA[<raw>]]></F><G/>"
    assert M.leaves(xml) == [("A / B", "1 < 2"), ("A / C / D / E", "y"), ("A / F", "<raw>")]
    assert M.unescape("&#65;&#x42;&nope;&amp") == "AB&nope;&amp"


def test_checksums(spark):
    from sonoframe.operators import fields as D

    row = D.checksums(spark.createDataFrame([(1, bytearray(b"123456789"))], "k long, b binary"), "k", "b").first()
    assert (row["crc8"], row["crc16"]) == (0xF4, 0xFEE8)


def test_timeline(spark):
    from sonoframe.operators import fields as D

    packets = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 150, 100), (1, 2, 200, 100), (1, 3, 99999, 10), (1, 4, 5, 10)], "rec_id long, ord long, at long, frames long")
    assert [(r["placed"], r["skipped"]) for r in D.timeline(packets, 480).orderBy("ord").collect()] == [(0, 0), (150, 0), (250, 50), (300, 0), (310, 10)]


def test_ticks(spark):
    row = spark.range(1).select(
        N.time_step(F.lit(0.5), F.lit(900)).alias("short"), N.step_decimals(F.lit(0.05)).alias("digits"), N.linear_ticks(F.lit(0.0), F.lit(24000.0), F.lit(275)).alias("linear"),
        N.log_ticks(F.lit(20.0), F.lit(20000.0), F.lit(60), F.lit(16)).alias("decades"), N.log_ticks(F.lit(20.0), F.lit(20000.0), F.lit(600), F.lit(16)).alias("all"),
        N.log_ticks(F.lit(0.0), F.lit(1.0), F.lit(60), F.lit(16)).alias("none"), N.linear_ticks(F.lit(5.0), F.lit(5.0), F.lit(275)).alias("empty"),
        N.level_text(F.lit(-100.0)).alias("floor"), N.level_text(F.lit(-6.02)).alias("level"), N.export_stem(F.lit("take"), F.lit(24000), F.lit(60000), F.lit(48000)).alias("name"),
    ).first()
    assert (row["short"], row["digits"], row["linear"]) == (0.05, 2, [0.0, 5000.0, 10000.0, 15000.0, 20000.0])
    assert (row["decades"], len(row["all"]), row["none"], row["empty"]) == ([100.0, 1000.0, 10000.0], 10, None, [])
    assert (row["floor"], row["level"], row["name"]) == ("-∞", "-6.0", "take 0.50-1.25 s")
