"""Reading recordings: walking folders, and WAV files from bytes to rows.

Spark lists and reads the files (`binaryFile`, so any store that Spark reads); a small parser turns each file's bytes
into a header, samples, texts and markers inside Arrow batches. A file that can't be read gives a row with `error`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import is_audio

#: Bytes of a text chunk that are looked at, at most.
TEXT_LIMIT = 16 << 20
HEADER = "container string, sample_rate long, channels long, bits long, floating boolean, frames long"
MARKERS = "array<struct<id:long,frame:long,length:long,label:string,note:string>>"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Audio files under a root, hidden ones and folders left out: path, folder, name, extension, bytes, modified."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = rows.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), name.alias("name"), F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.where(is_audio(F.col("extension")) & ~F.col("path").rlike(r"/\."))


def decode_text(raw: bytes) -> str:
    """Bytes up to a NUL as UTF-8, or else as Windows-1252; trimmed."""
    raw = raw.split(b"\0", 1)[0]
    try:
        return raw.decode().strip()
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace").strip()


class Held:
    """Bytes in memory, read in ranges like a file."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class Opened:
    """A seekable file, read in ranges: only what is asked for is fetched."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))


def chunks(file: Held | Opened) -> tuple[str, list[tuple[bytes, int, int]]]:
    """A RIFF file's container and chunks (id, start, end), by their heads alone.

    64-bit sizes come from ds64; data of size 0 goes to the end; a size past the end is cut.
    """
    head = file.read(0, 12)
    kind = head[:4]
    if kind not in (b"RIFF", b"RF64", b"BW64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    out, at, wide = [], 12, None
    while len(head := file.read(at, 8)) == 8:
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        start = at + 8
        if name == b"ds64" and len(sizes := file.read(start + 8, 8)) == 8 and size >= 16:
            wide = struct.unpack("<Q", sizes)[0]
        if name == b"data":
            size = wide if size == 0xFFFFFFFF and wide is not None else file.size - start if size == 0 else size
        end = min(start + size, file.size)
        out.append((name, start, end))
        at = end + size % 2
    return kind.decode(), out


def samples(raw: bytes, bits: int, floating: bool) -> np.ndarray:
    """Little-endian PCM as numbers from -1 to 1; what doesn't fill a sample is dropped."""
    width = bits // 8
    raw = raw[: len(raw) - len(raw) % width]
    if floating:
        return np.frombuffer(raw, f"<f{width}").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    return np.frombuffer(raw, f"<i{width}") / 2.0 ** (bits - 1)


def parse(data: bytes | Held | Opened, texts: bool = True) -> dict:
    """A WAV file's header and where its samples are; its texts and markers too, if asked for. Samples aren't read."""
    file = Held(data) if isinstance(data, bytes) else data
    container, found = chunks(file)
    first: dict[bytes, tuple[int, int]] = {}
    for name, a, b in found:
        first.setdefault(name, (a, b))
    if b"fmt " not in first or b"data" not in first:
        raise ValueError("no format or no data")
    body = lambda a, b: file.read(a, min(b - a, TEXT_LIMIT))
    fmt = body(*first[b"fmt "])
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if tag == 0xFFFE and len(fmt) >= 26:
        tag = struct.unpack_from("<H", fmt, 24)[0]
    if (tag, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)} or not channels or not rate:
        raise ValueError("a coding that isn't read")
    a, b = first[b"data"]
    out = {"container": container, "sample_rate": rate, "channels": channels, "bits": bits, "floating": tag == 3, "frames": (b - a) // (channels * bits // 8), "data": (a, b)}
    if not texts:
        return out
    out |= bext(body(*first[b"bext"])) if b"bext" in first else {}
    for name, key in ((b"iXML", "ixml"), (b"guan", "guano")):
        out |= {key: decode_text(body(*first[name]))} if name in first else {}
    lists = [(n, body(a, b)) for n, a, b in found if n in (b"LIST", b"cue ")]
    out["info"] = [(k.decode("latin-1"), decode_text(v)) for n, x in lists if n == b"LIST" and x[:4] == b"INFO" for k, v in entries(x[4:])]
    out["markers"] = markers(lists)
    return out


def entries(body: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(body):
        size = struct.unpack_from("<I", body, at + 4)[0]
        yield body[at : at + 4], body[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def bext(body: bytes) -> dict:
    """A broadcast chunk's fields, which stand at fixed places."""
    if len(body) < 346:
        return {}
    text = lambda a, b: decode_text(body[a:b])
    return {"description": text(0, 256), "originator": text(256, 288), "reference": text(288, 320), "date": text(320, 330), "time": text(330, 338), "time_reference": struct.unpack_from("<Q", body, 338)[0], "history": text(602, len(body))}


def markers(bodies: list[tuple[bytes, bytes]]) -> list[tuple[int, int, int, str | None, str | None]]:
    """Cue points with their labels, notes and lengths, by frame and id; a text is used once, the last of an id wins."""
    points, label, note, extent, named = [], {}, {}, {}, {}
    for name, x in bodies:
        if name == b"cue ":
            n = struct.unpack_from("<I", x)[0] if len(x) >= 4 else 0
            points += [struct.unpack_from("<IIIIII", x, 4 + 24 * i) for i in range(min(n, (len(x) - 4) // 24))]
        elif x[:4] == b"adtl":
            for kind, body in entries(x[4:]):
                if len(body) >= 4:
                    key = struct.unpack_from("<I", body)[0]
                    if kind == b"labl":
                        label[key] = decode_text(body[4:])
                    elif kind == b"note":
                        note[key] = decode_text(body[4:])
                    elif kind == b"ltxt" and len(body) >= 20:
                        extent[key], named[key] = struct.unpack_from("<I", body, 4)[0], decode_text(body[20:])
    out = []
    for key, *_, frame in points:
        text = named.pop(key, None)
        out.append((key, frame, extent.pop(key, 0), label.pop(key, None) or text or None, note.pop(key, None)))
    return sorted(out, key=lambda m: (m[1], m[0]))


#: The columns of a file's header row.
KINDS = {
    "path": pa.string(), "container": pa.string(), "sample_rate": pa.int64(), "channels": pa.int64(), "bits": pa.int64(), "floating": pa.bool_(), "frames": pa.int64(),
    "description": pa.string(), "originator": pa.string(), "date": pa.string(), "time": pa.string(), "time_reference": pa.int64(), "ixml": pa.string(), "guano": pa.string(),
    "info": pa.list_(pa.struct([("id", pa.string()), ("text", pa.string())])),
    "markers": pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int64()), ("length", pa.int64()), ("label", pa.string()), ("note", pa.string())])), "error": pa.string(),
}
HEADERS = f"path string, {HEADER}, description string, originator string, date string, time string, time_reference long, ixml string, guano string, info array<struct<id:string,text:string>>, markers {MARKERS}, error string"


def header_row(path: str, file: bytes | Held | Opened, texts: bool = True) -> dict:
    """A file's row of HEADERS: what it holds, or why it can't be read."""
    try:
        row = parse(file, texts)
    except (ValueError, struct.error, OSError) as e:
        return dict.fromkeys(KINDS) | {"path": path, "error": str(e)}
    if texts:
        row["info"] = [{"id": k, "text": v} for k, v in row["info"]]
        row["markers"] = [dict(zip(("id", "frame", "length", "label", "note"), m)) for m in row["markers"]]
    return {k: row.get(k) for k in KINDS} | {"path": path}


def headers(files: DataFrame) -> DataFrame:
    """Of (path, content): header, broadcast description, texts, markers and error of each file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [header_row(path, content.as_py()) for path, content in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(KINDS.items()))

    return files.select("path", "content").mapInArrow(work, HEADERS)


def signal(files: DataFrame, block: int = 1 << 14) -> DataFrame:
    """Of (path, content): blocks (path, channel, first_frame, samples) of each WAV file that can be read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                try:
                    info = parse(data := bytes(content))
                except (ValueError, struct.error):
                    continue
                step = info["channels"] * info["bits"] // 8
                for first in range(0, info["frames"], block):
                    a = info["data"][0] + first * step
                    raw = data[a : min(a + block * step, info["data"][0] + info["frames"] * step)]
                    x = samples(raw, info["bits"], info["floating"]).reshape(-1, info["channels"])
                    yield pd.DataFrame({"path": path, "channel": range(info["channels"]), "first_frame": first, "samples": list(x.T)})

    return files.select("path", "content").mapInPandas(work, "path string, channel int, first_frame long, samples array<double>")


def wav_bytes(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A WAV file of whole numbers (frames, channels) of 8, 16, 24 or 32 bits."""
    x = np.atleast_2d(np.asarray(x).T).T
    n, channels = x.shape
    if bits == 8:
        body = (x + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = x.astype(f"<i{bits // 8}").tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body + pad
