"""The data source for recordings: ranged reads of long files, partitions, and files that appear whole or not at all."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql.types import StructType

from sonoframe.sources import dataset as D
from sonoframe.sources import recordings as R

from .test_signals import FMT, chunk, wav


def test_header_of_a_file_over_2_gb_is_read_in_ranges(spark, tmp_path, monkeypatch):
    body = 5 << 30
    head = b"RF64\xff\xff\xff\xffWAVE" + chunk(b"ds64", struct.pack("<QQQI", body + 100, body, body // 2, 0)) + FMT + b"data\xff\xff\xff\xff"
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + body - 2)  # a hole: the file takes no room
        f.write(struct.pack("<h", 12345))
        f.write(chunk(b"LIST", b"INFO" + chunk(b"INAM", b"Night\0")))
    row = D.read_headers(spark, str(tmp_path)).first()
    assert (row["container"], row["frames"], row["error"]) == ("RF64", body // 2, None)
    assert [(x["id"], x["text"]) for x in row["info"]] == [("INAM", "Night")]
    last = D.read_blocks(spark, str(tmp_path), first=str(body // 2 - 3), count="10").collect()
    assert [(r["first_frame"], r["samples"]) for r in last] == [(body // 2 - 3, [0.0, 0.0, 12345 / 32768])]
    read = []
    monkeypatch.setattr(R.Opened, "read", lambda self, at, n, f=R.Opened.read: read.append(n) or f(self, at, n))
    with D.fs.LocalFileSystem().open_input_file(str(path)) as file:
        assert R.header_row("x", R.Opened(file), texts=False)["frames"] == body // 2
    assert sum(read) < 1000


@pytest.mark.parametrize("size", [64, 100, 1000, 1 << 20])
def test_blocks_do_not_depend_on_partitions(spark, tmp_path, size):
    rng = np.random.default_rng(1)
    made = {}
    for i, n in enumerate((0, 1, 37, 500)):
        x = rng.integers(-30000, 30000, (n, 2))
        made[f"{i}.wav"] = x / 32768
        (tmp_path / f"{i}.wav").write_bytes(R.wav_bytes(x, 48000))
    (tmp_path / "bad.wav").write_bytes(b"junk")
    rows = D.read_blocks(spark, str(tmp_path), block="30", partitionBytes=str(size)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["first_frame"]):
        assert r["first_frame"] % 30 == 0
        got.setdefault((os.path.basename(r["path"]), r["channel"]), []).extend(r["samples"])
    assert got == {(name, k): x[:, k].tolist() for name, x in made.items() if len(x) for k in (0, 1)}
    assert {os.path.basename(r["path"]): r["error"] is None for r in D.read_headers(spark, str(tmp_path), partitionFiles="2").collect()} == {"0.wav": True, "1.wav": True, "2.wav": True, "3.wav": True, "bad.wav": False}


def test_folders_are_walked_once_and_hidden_names_left_out(tmp_path):
    for name in ("a.wav", "b.txt", ".c.wav", "day/d.WAV", ".night/e.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path, tmp_path / "day" / "again")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.wav")
    assert [os.path.relpath(p, tmp_path) for p, _ in D.walked(str(tmp_path))] == ["a.wav", "day/d.WAV"]
    assert [p for p, _ in D.walked(f"file://{tmp_path}/a.wav")] == [f"file://{tmp_path}/a.wav"]


def test_an_unreadable_folder_is_skipped(tmp_path, monkeypatch):
    (tmp_path / "locked").mkdir()
    (tmp_path / "a.wav").write_bytes(b"x")

    class Listing:
        """A file system that refuses one folder."""

        def __init__(self):
            self.system = D.fs.LocalFileSystem()

        def get_file_info(self, x):
            if isinstance(x, D.fs.FileSelector) and x.base_dir.endswith("locked"):
                raise PermissionError(x.base_dir)
            return self.system.get_file_info(x)

    monkeypatch.setattr(D, "opened", lambda path: (Listing(), path))
    assert [os.path.basename(p) for p, _ in D.walked(str(tmp_path))] == ["a.wav"]


SCHEMA = "name string, first_frame long, channels int, sample_rate int, bits int, floating boolean, samples array<double>"


def test_gaps_are_silent_and_halves_round_away(spark, tmp_path):
    rows = [("a.wav", 3, 1, 8000, 16, False, [0.5, -2.0, 1.5 / 32768, -1.5 / 32768]), ("a.wav", 0, 1, 8000, 16, False, [1.0]), (None, 0, 1, 8000, 16, False, [0.0]), ("b.wav", 0, 1, 8000, 16, False, None), ("c.wav", 0, 3, 8000, 8, None, [0.0, 0.5, -1.0])]
    D.write_recordings(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.wav", "c.wav"]
    data = (tmp_path / "out" / "a.wav").read_bytes()
    info = R.parse(data)
    assert np.frombuffer(data[slice(*info["data"])], "<i2").tolist() == [32767, 0, 0, 16384, -32768, 2, -2]
    c = R.parse((tmp_path / "out" / "c.wav").read_bytes())
    assert (c["channels"], c["bits"], c["frames"]) == (3, 8, 1)


def test_nothing_appears_unless_all_is_committed(spark, tmp_path):
    folder = tmp_path / "out"
    good = ("a.wav", 0, 1, 8000, 16, False, [0.0])
    for bad in (("b.wav", 1, 2, 8000, 16, False, [0.0]), ("../b.wav", 0, 1, 8000, 16, False, [0.0]), ("b.wav", 0, 1, 8000, 16, False, [0.0])):
        twice = bad == ("b.wav", 0, 1, 8000, 16, False, [0.0])
        rows = spark.createDataFrame([good, bad], SCHEMA)
        with pytest.raises(Exception):  # noqa: B017
            if twice:  # a recording's blocks in two tasks
                D.register(spark)
                rows.union(rows).repartition(4).write.format("recordings").mode("append").save(str(folder))
            else:
                D.write_recordings(rows, str(folder))
        assert os.listdir(folder) == []
    D.write_recordings(spark.createDataFrame([good], SCHEMA), str(folder))
    with pytest.raises(Exception):  # noqa: B017
        D.write_recordings(spark.createDataFrame([good], SCHEMA), str(folder))
    D.write_recordings(spark.createDataFrame([good], SCHEMA), str(folder), "overwrite")
    assert os.listdir(folder) == ["a.wav"]


def test_a_narrow_schema_and_an_unknown_column(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(FMT, chunk(b"iXML", b"<x/>"), chunk(b"guan", b"GUANO|Version: 1.0\0"), chunk(b"data", b"\0\0")))
    assert D.read_headers(spark, str(tmp_path), "frames long").collect()[0].asDict() == {"frames": 1}
    row = D.read_headers(spark, str(tmp_path)).first()
    assert (row["ixml"], row["guano"]) == ("<x/>", "GUANO|Version: 1.0")
    assert D.read_headers(spark, str(tmp_path / "none" if (tmp_path / "none").mkdir() is None else "")).count() == 0
    with pytest.raises(Exception, match="no columns"):
        D.read_headers(spark, str(tmp_path), "colour string").collect()


def test_many_small_files_pass_in_few_tasks_and_batches(spark, tmp_path):
    x = np.arange(40)[:, None] * np.array([[1, 2]])
    for i in range(3000):
        (tmp_path / f"{i}.wav").write_bytes(R.wav_bytes(x[:, : 1 + i % 2], 48000))
    found = D._Reader({"path": str(tmp_path), "samples": "true", "block": "16", "partitionbytes": "200", "partitions": "20"}, StructType.fromDDL(D.BLOCKS))
    tasks = found.partitions()
    assert 10 <= len(tasks) <= 40 and len({path for t in tasks for path, _, _ in t.files}) == 3000
    batches = [b for t in tasks for b in found.read(t)]
    assert len(batches) == len(tasks)
    rows = D.read_blocks(spark, str(tmp_path), block="16", partitionBytes="200", partitions="20")
    whole = sorted((os.path.basename(r["path"]), r["channel"], r["first_frame"], r["samples"]) for r in rows.collect())
    assert len(whole) == 3000 // 2 * 3 * 3
    assert whole == sorted((os.path.basename(r["path"]), r["channel"], r["first_frame"], r["samples"]) for b in batches for r in b.to_pylist())
    assert all(values == (x[first : first + 16, k] / 32768).tolist() for _, k, first, values in whole)
