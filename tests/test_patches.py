"""Markers and texts to bytes and back: what nobody changed stays byte for byte."""

import struct

import pytest

from sonoframe.functions import metadata as M
from sonoframe.sources import patches as B
from sonoframe.sources import recordings as R

from .test_signals import FMT, chunk, wav

CUE = struct.pack("<I", 2) + struct.pack("<II4sIII", 1, 7, b"data", 1, 2, 4800) + struct.pack("<II4sIII", 2, 9, b"slnt", 3, 4, 24000)
ADTL = b"adtl" + chunk(b"labl", struct.pack("<I", 1) + b"Caf\xe9\0\0") + chunk(b"ltxt", struct.pack("<II4s", 2, 9600, b"xyz ") + b"\1\2\3\4\5\6\7\x08bat pass\0") + chunk(b"file", b"odd") + chunk(b"note", struct.pack("<I", 2) + b"two calls\0")
INFO = b"INFO" + chunk(b"INAM", b"Night\0\0\0") + chunk(b"ICMT", b"Caf\xe9\0")
DATA = chunk(b"data", bytes(range(100)))


def dicts(data):
    return [dict(zip(("id", "frame", "length", "label", "note"), m)) for m in R.parse(data)["markers"]]


@pytest.fixture
def stored():
    return wav(FMT, chunk(b"junk", b"abc"), chunk(b"cue ", CUE), chunk(b"LIST", ADTL), DATA, chunk(b"LIST", INFO), chunk(b"ID3 ", b"xx"))


def test_what_is_unchanged_goes_back_as_it_was(stored):
    found = dicts(stored)
    assert [(m["label"], m["length"], m["note"]) for m in found] == [("Café", 0, None), ("bat pass", 9600, "two calls")]
    info = [(k.encode(), v) for k, v in R.parse(stored)["info"]]
    again = B.marked(stored, found, info)
    same = {name: [x for x in B._parts(again) if x[0] == name] for name in (b"fmt ", b"junk", b"data", b"ID3 ", b"cue ")}
    assert all(same[n] == [x for x in B._parts(stored) if x[0] == n] for n in same) and dicts(again) == found
    lists = [b for n, b, _ in B._parts(again) if n == b"LIST"]
    assert sorted(lists[0][4:]) == sorted(ADTL[4:]) and lists[1] == INFO  # the same subchunks, by marker
    assert B.marked(stored) == stored
    assert [n for n, _, _ in B._parts(again)] == [b"fmt ", b"junk", b"cue ", b"LIST", b"data", b"LIST", b"ID3 "]


def test_changes_are_written_and_read(stored):
    marks = [{"id": 1, "frame": 4800, "length": 5, "label": "owl", "note": "hoo"}, {"id": 2, "frame": 24001, "length": 9600, "label": "bat pass", "note": None}, {"id": 9, "frame": 2**40, "length": 0, "label": "", "note": ""}]
    again = B.marked(stored, marks, [(b"ICMT", "Café"), (b"IART", "Ärtist")])
    assert dicts(again) == [{"id": 1, "frame": 4800, "length": 5, "label": "owl", "note": "hoo"}, {"id": 2, "frame": 24001, "length": 9600, "label": "bat pass", "note": None}, {"id": 9, "frame": 2**32 - 1, "length": 0, "label": None, "note": None}]
    adtl = next(b for n, b, _ in B._parts(again) if n == b"LIST" and b[:4] == b"adtl")
    assert b"labl" not in adtl.split(b"bat pass")[0][-8:] and adtl.count(b"bat pass") == 1 and chunk(b"file", b"odd") in adtl  # the region alone keeps its name
    assert R.parse(again)["info"] == [("ICMT", "Café"), ("IART", "Ärtist")] and b"Caf\xe9\0" in again
    bare = B.marked(stored, [], [])
    assert R.parse(bare)["markers"] == [] and R.parse(bare)["info"] == [] and struct.unpack_from("<I", bare, 4)[0] == len(bare) - 8
    kept = next(b for n, b, _ in B._parts(bare) if n == b"LIST")
    assert kept == b"adtl" + chunk(b"file", b"odd")


def test_a_region_whose_name_changed_is_written_anew(stored):
    renamed = dicts(stored)
    renamed[1]["label"] = "another"
    adtl = next(b for n, b, _ in B._parts(B.marked(stored, renamed)) if n == b"LIST" and b[:4] == b"adtl")
    assert b"bat pass" not in adtl and b"rgn " in adtl and b"another" in adtl


def test_counts_at_another_rate():
    bext = bytes(338) + struct.pack("<Q", 2**33 + 1) + bytes(256)
    smpl = struct.pack("<9I", 0, 0, 20833, 0, 0, 0, 0, 1, 0) + struct.pack("<6I", 0, 0, 4800, 9600, 0, 0)
    data = wav(FMT, chunk(b"bext", bext), chunk(b"smpl", smpl), chunk(b"cue ", CUE), chunk(b"LIST", ADTL), DATA)
    again = B.at_rate(data, 44100)
    found = R.parse(again)
    assert found["time_reference"] == (2**33 + 1) * 44100 // 48000 and [(m[1], m[2]) for m in found["markers"]] == [(4410, 0), (22050, 8820)]
    body = next(b for n, b, _ in B._parts(again) if n == b"smpl")
    assert struct.unpack_from("<I", body, 8)[0] == round(1e9 / 44100) and struct.unpack_from("<II", body, 44) == (4410, 8820)
    assert len(again) == len(data) and B.at_rate(data, 48000)[:100] == data[:100]


def test_rf64_and_files_that_are_none(spark):
    body = b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", 0, 100, 50, 0)) + FMT + b"data\xff\xff\xff\xff" + bytes(100)
    again = B.marked(b"RF64\xff\xff\xff\xff" + body, [{"id": 1, "frame": 3}], None)
    assert R.parse(again)["frames"] == 50 and [m[:2] for m in R.parse(again)["markers"]] == [(1, 3)]
    assert struct.unpack_from("<Q", again, 20)[0] == len(again) - 8
    rows = [("a", bytearray(b"junk"), None, None), ("b", None, [], None), ("c", bytearray(wav(FMT, DATA)), None, [("INAM", "x")])]
    frame = spark.createDataFrame(rows, "path string, content binary, markers array<struct<id:long,frame:long,length:long,label:string,note:string>>, info array<struct<id:string,text:string>>")
    found = {r["path"]: r for r in B.patched(frame).collect()}
    assert found["a"]["error"] and bytes(found["a"]["content"]) == b"junk" and found["b"]["error"] and R.parse(bytes(found["c"]["content"]))["info"] == [("INAM", "x")]


def test_xml_trees():
    xml = "<A><B>1</B><B/><B>3 <!-- x --></B><C><D>x</C></STRAY><E> </E></A>"
    assert M.leaves(xml) == [("A / B", "1"), ("A / B", "3"), ("A / C / D", "x")]
    assert M.leaves(xml, numbered=True) == [("A / B 1", "1"), ("A / B 3", "3"), ("A / C / D", "x")]
    assert M.details("<X><TRACK_LIST><TRACK><CHANNEL_INDEX>1</CHANNEL_INDEX><FUNCTION>M</FUNCTION></TRACK><TRACK/></TRACK_LIST><S><T>2</T></S></X>") == [("Track 1", "M"), ("S / T", "2")]
    assert M.leaves("") == M.details("") == M.leaves("no markup") == []
