"""A Spark data source for WAV recordings: `spark.read.format("recordings")` and `df.write.format("recordings")`.

Reading. Headers come by ranged reads of the chunks' heads and of the small chunks that the schema asks for, so a file of
any size costs a few kilobytes; give a schema of fewer columns to read less. With option `samples` true, rows are
blocks of samples: files are cut into ranges of `partitionBytes` bytes, a task reads the blocks that begin in its
ranges, and `first` and `count` leave all other frames unread. Where so small ranges would make more than about
`partitions` tasks (512), ranges grow with the bytes in all, to 64 MB at most: a task costs as much as hundreds of small
files. Blocks pass in batches of up to about 1 MB. Nothing of a file but its name and size passes the driver. Paths are
what pyarrow's file systems open: local or mounted folders, and object stores by their URI.

Folders are walked by canonical name, each once, so that links don't lead in circles; hidden names are left out, and
folders that can't be read are skipped.

Writing. Rows are blocks of interleaved samples, in order and all of a file in one task (`write_recordings` deals them
so). A task writes each file under a hidden name and patches its sizes, as RF64 where they pass 32 bits; the commit
renames all files. A failed or repeated task leaves nothing that a reader sees.

Defined results: a file that can't be read gives a header row with `error`, and no blocks; a file without frames gives no blocks; an
empty folder gives no rows. Writing: rows with a null name or samples are left out; frames that no block holds are
silent; a block that overlaps the one before, or a file in two tasks, fails the job and leaves no file.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .recordings import HEADERS, KINDS, Opened, header_row, parse, samples

AUDIO = "wav"
BLOCKS = "path string, channel int, first_frame long, samples array<double>"
#: Bytes that a task's ranges have at most where they grow to keep tasks few, and numbers that a batch of blocks holds, besides its last block's.
_RANGE, _NUMBERS = 64 << 20, 1 << 17
_TEXTS = {"description", "originator", "date", "time", "time_reference", "ixml", "guano", "info", "markers"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def walked(root: str, extensions: tuple[str, ...] = (AUDIO,)) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files under a root, by name."""
    system, top = opened(root)
    prefix = root[: len(root) - len(top)] if root.endswith(top) and "://" in root else ""
    local = isinstance(system, fs.LocalFileSystem)
    folders, seen = [top], set()
    if (info := system.get_file_info(top)).type == fs.FileType.File:
        yield prefix + top, info.size
        return
    while folders:
        folder = folders.pop()
        name = os.path.realpath(folder) if local else folder
        if name in seen:
            continue
        seen.add(name)
        try:
            found = sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path)
        except OSError:
            continue
        for x in found:
            if x.base_name.startswith("."):
                continue
            if x.type == fs.FileType.Directory:
                folders.append(x.path)
            elif x.type == fs.FileType.File and x.extension.lower() in extensions:
                yield prefix + x.path, x.size


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, first byte, end byte) of each file."""

    files: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.roots = [x for x in options.get("path", "").split(",") if x]
        self.blocks = options.get("samples", "false").lower() == "true"
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.files = int(options.get("partitionfiles", 256))
        self.tasks = int(options.get("partitions", 512))
        self.block = int(options.get("block", 1 << 14))
        self.first = int(options.get("first", 0))
        self.end = self.first + int(options["count"]) if "count" in options else None
        self.columns = schema.fieldNames()
        known = ["path", "channel", "first_frame", "samples"] if self.blocks else list(KINDS)
        if unknown := set(self.columns) - set(known):
            raise ValueError(f"recordings have no columns {sorted(unknown)}")

    def partitions(self) -> list[Ranges]:
        files = [x for root in self.roots for x in walked(root)]
        most = max(self.bytes, min(_RANGE, sum(size for _, size in files) // self.tasks)) if self.blocks else self.bytes
        out, held, room = [], [], most
        for path, size in files:
            for a in range(0, max(size, 1), most) if self.blocks else (0,):
                b = min(a + most, size)
                cost = b - a if self.blocks else most // self.files
                if held and cost > room:
                    out.append(Ranges(held))
                    held, room = [], most
                held.append((path, a, b))
                room -= cost
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if not self.blocks:
            wanted, schema = bool(_TEXTS & set(self.columns)), pa.schema([(c, KINDS[c]) for c in self.columns])
            rows = []
            for path, _, _ in partition.files:
                row = self._header(path, wanted)
                rows.append({c: row[c] for c in self.columns})
            yield pa.RecordBatch.from_pylist(rows, schema)
            return
        held, numbers = [], 0
        for path, a, b in partition.files:
            for first, x in self._samples(path, a, b):
                held.append((path, first, x))
                numbers += x.size
                if numbers >= _NUMBERS:
                    yield self._batch(held)
                    held, numbers = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, blocks: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        """Blocks (path, first frame, samples by frame and channel) as rows, one a channel."""
        channels = np.array([x.shape[1] for _, _, x in blocks])
        each = np.repeat(np.arange(len(blocks)), channels)
        made = {
            "path": lambda: pa.array([blocks[i][0] for i in each], pa.string()),
            "channel": lambda: pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in channels])),
            "first_frame": lambda: pa.array(np.array([first for _, first, _ in blocks], dtype=np.int64)[each]),
            "samples": lambda: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(blocks[i][2]) for i in each])]).astype(np.int32)), pa.array(np.concatenate([x.T.ravel() for _, _, x in blocks]))),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)

    def _header(self, path: str, texts: bool) -> dict:
        system, name = opened(path)
        try:
            with system.open_input_file(name) as file:
                return header_row(path, Opened(file), texts)
        except OSError as e:
            return dict.fromkeys(KINDS) | {"path": path, "error": str(e)}

    def _samples(self, path: str, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """First frame and samples of the blocks whose first byte is in the range; the range that begins the file has those before it too."""
        system, name = opened(path)
        try:
            file = system.open_input_file(name)
        except OSError:
            return
        with file:
            try:
                info = parse(source := Opened(file), texts=False)
            except (ValueError, struct.error, OSError):
                return
            start, step = info["data"][0], info["channels"] * info["bits"] // 8
            stop = info["frames"] if self.end is None else min(self.end, info["frames"])
            size = step * self.block
            block = max(0, -(-(a - start) // size), self.first // self.block)
            while block * self.block < stop and (start + block * size < b):
                first, last = max(block * self.block, self.first), min((block + 1) * self.block, stop)
                if last > first:
                    yield first, samples(source.read(start + first * step, (last - first) * step), info["bits"], info["floating"]).reshape(-1, info["channels"])
                block += 1


# fixed values: the tail of the sub-format identifiers of extensible formats
SUBFORMAT = bytes.fromhex("000000001000800000AA00389B71")


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def format_body(channels: int, rate: int, bits: int, floating: bool) -> bytes:
    """A `fmt ` body: extensible for more than two channels, or whole numbers of more than 16 bits."""
    width = -(-bits // 8)
    extensible = channels > 2 or bits > 16 and not floating
    tag = 0xFFFE if extensible else 3 if floating else 1
    body = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, width * 8)
    if extensible:
        mask = {1: 4, 2: 3}.get(channels, 0)
        return body + struct.pack("<HHIH", 22, bits, mask, 3 if floating else 1) + SUBFORMAT
    return body + (b"\0\0" if floating else b"")


def packed(x: np.ndarray, bits: int, floating: bool) -> bytes:
    """Numbers from -1 to 1 as little-endian samples: the nearest whole numbers, halves away from zero, within range."""
    if floating:
        return x.astype(f"<f{bits // 8}").tobytes()
    full = 2.0 ** (bits - 1)
    whole = np.clip(np.trunc(x * full + np.copysign(0.5, x)), -full, full - 1).astype(np.int64)
    if bits == 8:
        return (whole + 128).astype(np.uint8).tobytes()
    return whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


class _File:
    """A file being written under a hidden name: a header with room for 64-bit sizes, then samples in order."""

    def __init__(self, folder: str, name: str, job: str, channels: int, rate: int, bits: int, floating: bool, limit: int):
        self.name, self.hidden = name, f"{folder}/.{job}-{uuid.uuid4().hex}"
        self.kind, self.limit, self.bytes, self.frames = (channels, rate, bits, floating), limit, 0, 0
        head = b"RIFF\0\0\0\0WAVE" + chunk(b"JUNK", bytes(28)) + chunk(b"fmt ", format_body(channels, rate, bits, floating))
        self.fact = len(head) + 8 if floating else None
        head += chunk(b"fact", bytes(4)) if floating else b""
        self.at = len(head) + 4
        self.file = open(self.hidden, "w+b")
        self.file.write(head + b"data\0\0\0\0")

    def add(self, first: int, x: np.ndarray) -> None:
        channels, _, bits, floating = self.kind
        if first < self.frames or len(x) % channels:
            raise ValueError(f"{self.name}: the block at frame {first} isn't in order, or isn't whole frames")
        step = channels * bits // 8
        gap = first - self.frames
        while gap:  # silence, a piece at a time
            n = min(gap, 1 << 16)
            self.bytes += self.file.write(packed(np.zeros(n * channels), bits, floating))
            gap -= n
        self.bytes += self.file.write(packed(x, bits, floating))
        self.frames = self.bytes // step

    def close(self) -> None:
        self.file.write(b"\0" * (self.bytes % 2))
        total = self.file.tell()
        patches = [(4, struct.pack("<I", total - 8)), (self.at, struct.pack("<I", self.bytes))]
        if total - 8 > self.limit:
            full = b"\xff" * 4
            patches = [(0, b"RF64" + full), (12, b"ds64"), (20, struct.pack("<QQQ", total - 8, self.bytes, self.frames)), (self.at, full)]
        if self.fact:
            patches.append((self.fact, struct.pack("<I", min(self.frames, 0xFFFFFFFF))))
        for at, value in patches:
            self.file.seek(at)
            self.file.write(value)
        self.file.close()

    def drop(self) -> None:
        self.file.close()
        _remove(self.hidden)


def _remove(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: (hidden name, name)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        path = options["path"]
        self.folder = path.removeprefix("file://").removeprefix("file:")
        if "://" in path and not path.startswith("file:"):
            raise ValueError("recordings are written to folders that the operating system opens, since their sizes are patched")
        self.job, self.overwrite = f"writing-{uuid.uuid4().hex}", overwrite
        self.limit = int(options.get("riffbytes", 0xFFFFFFFF))
        self.at = {n: i for i, n in enumerate(schema.fieldNames())}
        if missing := {"name", "first_frame", "channels", "sample_rate", "bits", "samples"} - set(self.at):
            raise ValueError(f"columns {sorted(missing)} are missing")
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[_File] = []
        try:
            for batch in iterator:
                lists, none = batch.column(self.at["samples"]), [None] * batch.num_rows
                columns = [batch.column(self.at[c]).to_pylist() if c in self.at else none for c in ("name", "first_frame", "channels", "sample_rate", "bits", "floating")]
                for x, name, first, *kind, floating in zip(lists, *columns):
                    if name is None or not x.is_valid:
                        continue
                    if not done or done[-1].name != name:
                        if done:
                            done[-1].close()
                        if os.path.basename(name) != name or name.startswith("."):
                            raise ValueError(f"{name!r} isn't a name for a recording")
                        done.append(_File(self.folder, name, self.job, *kind, bool(floating), self.limit))
                    done[-1].add(first or 0, np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64))
            if done:
                done[-1].close()
        except BaseException:
            for file in done:
                file.drop()
            raise
        return Written([(f.hidden, f.name) for f in done])

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in files]
        there = set() if self.overwrite else set(os.listdir(self.folder))
        taken = [n for n in names if n in there]
        if len(set(names)) < len(names) or taken:
            self.abort(messages)
            raise ValueError(f"a recording's blocks were in two tasks, or its name is taken: {sorted({n for n in names if names.count(n) > 1} | set(taken))[:5]}")
        for hidden, name in files:
            os.replace(hidden, f"{self.folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Hidden files of this job, also of tasks whose messages are lost."""
        for name in os.listdir(self.folder):
            if name.startswith(f".{self.job}"):
                _remove(f"{self.folder}/{name}")


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return BLOCKS if self.options.get("samples", "false").lower() == "true" else HEADERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recordings)


def read_headers(spark: SparkSession, root: str, schema: str | None = None, **options: str) -> DataFrame:
    register(spark)
    reader = spark.read.format("recordings").options(**options)
    return (reader.schema(schema) if schema else reader).load(root)


def read_blocks(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path, channel, first_frame, samples; options first, count, block, partitionBytes, partitions."""
    register(spark)
    return spark.read.format("recordings").options(samples="true", **options).load(root)


def write_recordings(blocks: DataFrame, folder: str, mode: str = "append", **options: str) -> None:
    """Writes blocks (name, first_frame, channels, sample_rate, bits, samples; floating if there) as WAV files of a folder."""
    register(blocks.sparkSession)
    dealt = blocks.repartition("name").sortWithinPartitions("name", "first_frame")
    dealt.write.format("recordings").options(**options).mode(mode).save(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; a local session without one gets one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sonoframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
