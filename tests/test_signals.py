"""Recordings: WAV bytes, spectra of tones, filters and streams."""

import math
import struct

import numpy as np
import pytest

from sonoframe.operators import spectral as P
from sonoframe.sources import recordings as R
from sonoframe.streaming import levels as L


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wav(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


FMT = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 48000, 96000, 2, 16))


def test_pcm():
    assert R.samples(b"\x00\x00\x80\x00\x00\x40", 24, False).tolist() == [-1.0, 0.5]
    assert R.samples(bytes([0, 128, 255]), 8, False).tolist() == [-1.0, 0.0, 127 / 128]


@pytest.mark.parametrize(("cut", "frames"), [(0, 100), (50, 75)])
def test_cut_files(cut, frames):
    data = wav(FMT, chunk(b"data", b"\1\0" * 100))
    assert R.parse(data[: len(data) - cut])["frames"] == frames


def test_size_zero_reaches_to_the_end():
    assert R.parse(wav(FMT, b"data\0\0\0\0" + b"\1\0" * 100))["frames"] == 100


def test_markers():
    cue = struct.pack("<I", 2) + struct.pack("<IIIIII", 2, 0, 0, 0, 0, 24000) + struct.pack("<IIIIII", 1, 0, 0, 0, 0, 4800)
    text = lambda k, i, s: chunk(k, struct.pack("<I", i) + s)
    adtl = b"adtl" + text(b"labl", 1, b"owl\0") + text(b"labl", 2, b"bat pass\0") + text(b"note", 2, b"two calls\0") + chunk(b"ltxt", struct.pack("<II", 2, 9600) + b"\0" * 12)
    found = R.parse(wav(FMT, chunk(b"cue ", cue), chunk(b"LIST", adtl), chunk(b"data", b"")))["markers"]
    assert found == [(1, 4800, 0, "owl", None), (2, 24000, 9600, "bat pass", "two calls")]


def test_text():
    assert R.decode_text(b"Caf\xe9 \0junk") == "Café" and R.decode_text(b"\x93hi\x94 \x805") == "“hi” €5"


def test_bad_files_are_rows(spark):
    rows = spark.createDataFrame([("good", bytearray(wav(FMT, chunk(b"data", b"\0\0")))), ("bad", bytearray(b"junk"))], "path string, content binary")
    found = {r["path"]: r for r in R.headers(rows).collect()}
    assert found["good"]["frames"] == 1 and found["good"]["error"] is None and found["bad"]["error"]


def test_walk(spark, tmp_path):
    for name in ("a.wav", "b.txt", ".hidden.wav", "day/c.FLAC"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in R.walk(spark, str(tmp_path)).collect()) == ["a.wav", "c.FLAC"]


def test_full_scale_tone(spark):
    n = 16384
    rows = [(1, i, math.sin(2 * math.pi * 100 * i / 2048)) for i in range(n)]
    signal = spark.createDataFrame(rows, "rec_id long, frame long, x double")
    lengths = spark.createDataFrame([(1, n)], "rec_id long, frames long")
    for block in (512, 1000):
        levels = np.array(P.spectrogram(P.blocks(signal, block), lengths, 8, 2048, group=3).where("column = 4").first()["levels"])
        assert levels.argmax() == 100 and abs(levels[100]) < 0.1 and levels[140] < -80


def test_peak_hold_state_carries_over():
    levels = [(0.0, -10.0), (1.0, -50.0), (2.0, -50.0), (3.0, -50.0)]
    whole, _ = L.held(levels)
    a, state = L.held(levels[:2])
    b, _ = L.held(levels[2:], state)
    assert whole == a + b == [-10.0, -10.0, -25.0, -40.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"2024-01-01 0{i % 6}:10:00", float(i)) for i in range(60)], "user_id long, ts string, x double").selectExpr("user_id", "cast(ts as timestamp) ts", "x")
    rows.write.parquet(str(tmp_path / "in"))
    live = L.level_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour", "1 hour")
    q = live.writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("levels").collect())) == sorted(map(tuple, L.level_windows(rows, "1 hour", "1 hour").collect()))


def test_held_peaks_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, -10.0), (1, 1.0, -50.0), (1, 2.0, -50.0)], "user_id long, at double, level double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = L.peak_hold(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("append").format("memory").queryName("held").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["shown"] for r in spark.table("held").collect()) == [-25.0, -10.0, -10.0]
