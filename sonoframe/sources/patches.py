"""Changing what a WAV file says without touching the rest: markers and INFO texts back to bytes, and sample counts at another rate.

A file's chunks are kept byte for byte, but for those that a change concerns; within those, whatever still says what it
said goes back as it was stored: a cue point of the same id and frame with its other fields, a name with its padding, a
text in its old encoding, subchunks of kinds that nobody edits.

Defined results: null markers or texts leave theirs as they are, empty ones take them away; frames and lengths past 32
bits are the greatest that fit; a file that isn't WAV comes back as it is, with `error`.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recordings import Held, chunks, decode_text, entries

MOST = 0xFFFFFFFF


def sub(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _said(kind: bytes, body: bytes) -> str:
    """The text of a labl, note or ltxt."""
    return decode_text(body[20:] if kind == b"ltxt" else body[4:])


class Stored:
    """A file's cue points and the subchunks that name them, by kind and id."""

    def __init__(self, cues: list[bytes] = (), lists: list[bytes] = ()):
        self.points: dict[tuple[int, int], bytes] = {}
        for body in cues:
            n = min(struct.unpack_from("<I", body)[0], (len(body) - 4) // 24) if len(body) >= 4 else 0
            for i in range(n):
                point = body[4 + 24 * i : 28 + 24 * i]
                self.points.setdefault((struct.unpack_from("<I", point)[0], struct.unpack_from("<I", point, 20)[0]), point)
        self.named: dict[tuple[bytes, int], list[bytes]] = defaultdict(list)
        self.others: list[tuple[bytes, bytes]] = []
        for kind, body in (x for part in lists for x in entries(part)):
            if kind not in (b"labl", b"note", b"ltxt"):
                self.others.append((kind, body))
            elif len(body) >= 4:
                self.named[kind, struct.unpack_from("<I", body)[0]].append(body)

    def saying(self, kind: bytes, key: int, test: Callable[[bytes], bool]) -> bytes | None:
        return next((b for b in self.named.get((kind, key), ()) if test(b)), None)


def mark_bodies(markers: list[dict], stored: Stored) -> tuple[bytes, bytes | None]:
    """A `cue ` body of markers (id, frame, length, label, note), and an adtl body of their lengths and texts, if there are any."""
    cue, texts = [struct.pack("<I", len(markers))], []
    for m in markers:
        key, frame, length = m["id"], min(m["frame"], MOST), min(m.get("length") or 0, MOST)
        label, note = m.get("label") or "", m.get("note") or ""
        cue.append(stored.points.get((key, frame)) or struct.pack("<II4sIII", key, frame, b"data", 0, 0, frame))
        kept_label = stored.saying(b"labl", key, lambda b: _said(b"labl", b) == label) if label else None
        region = None
        if length:
            # a region's own name must be the marker's, be none, or stand behind a label that is kept
            fits = lambda b: len(b) >= 8 and struct.unpack_from("<I", b, 4)[0] == length and (_said(b"ltxt", b) in ("", label) or kept_label is not None)  # noqa: B023, E731
            region = stored.saying(b"ltxt", key, fits)
            texts.append(sub(b"ltxt", region or struct.pack("<II4s8x", key, length, b"rgn ")))
        if label and (kept_label or region is None or _said(b"ltxt", region) != label):
            texts.append(sub(b"labl", kept_label or struct.pack("<I", key) + label.encode() + b"\0"))
        if note:
            texts.append(sub(b"note", stored.saying(b"note", key, lambda b: _said(b"note", b) == note) or struct.pack("<I", key) + note.encode() + b"\0"))  # noqa: B023
    texts += [sub(kind, body) for kind, body in stored.others]
    return b"".join(cue), b"adtl" + b"".join(texts) if texts else None


def info_body(texts: list[tuple[bytes, str]], stored: list[tuple[bytes, bytes]]) -> bytes:
    """An INFO body of (id, text); each takes a stored entry of the same id and text, once, or is written anew."""
    left = list(stored)
    out = [b"INFO"]
    for key, text in texts:
        own = next((x for x in left if x[0] == key and decode_text(x[1]) == text), None)
        if own:
            left.remove(own)
        out.append(sub(key, own[1] if own else text.encode() + b"\0"))
    return b"".join(out)


def rebuilt(data: bytes, parts: list[tuple[bytes, bytes, int]]) -> bytes:
    """A file of chunks (id, body, size as its head has it), with the sizes of the whole put right; RF64's in its ds64."""
    out = bytearray(data[:12])
    for name, body, size in parts:
        out += name + struct.pack("<I", size) + body + b"\0" * (len(body) % 2)
    if data[:4] == b"RIFF":
        struct.pack_into("<I", out, 4, len(out) - 8)
    else:
        at = next(a for n, a, _ in chunks(Held(bytes(out)))[1] if n == b"ds64")
        struct.pack_into("<Q", out, at, len(out) - 8)
    return bytes(out)


def _parts(data: bytes) -> list[tuple[bytes, bytes, int]]:
    return [(n, data[a:b], struct.unpack_from("<I", data, a - 4)[0]) for n, a, b in chunks(Held(data))[1]]


def marked(data: bytes, markers: list[dict] | None = None, info: list[tuple[bytes, str]] | None = None) -> bytes:
    """A file with other markers and INFO texts; a change stands where the first of what it replaces stood, or last."""
    parts = _parts(data)
    of = lambda part: "marks" if part[0] == b"cue " or part[0] == b"LIST" and part[1][:4] == b"adtl" else "info" if part[0] == b"LIST" and part[1][:4] == b"INFO" else None
    new: dict[str, list[tuple[bytes, bytes, int]]] = {}
    if markers is not None:
        cue, adtl = mark_bodies(markers, Stored([b for n, b, _ in parts if n == b"cue "], [b[4:] for n, b, _ in parts if n == b"LIST" and b[:4] == b"adtl"]))
        new["marks"] = ([(b"cue ", cue, len(cue))] if markers else []) + ([(b"LIST", adtl, len(adtl))] if adtl else [])
    if info is not None:
        body = info_body(info, [x for n, b, _ in parts if n == b"LIST" and b[:4] == b"INFO" for x in entries(b[4:])])
        new["info"] = [(b"LIST", body, len(body))] if info else []
    out: list[tuple[bytes, bytes, int]] = []
    for part in parts:
        if (kind := of(part)) is None or (kind == "marks" and markers is None) or (kind == "info" and info is None):
            out.append(part)
        else:
            out += new.pop(kind, [])
    return rebuilt(data, out + [x for rest in new.values() for x in rest])


def _counted(body: bytes, places: list[int], move: Callable[[int], int]) -> bytes:
    out = bytearray(body)
    for at in places:
        if at + 4 <= len(out):
            struct.pack_into("<I", out, at, min(move(struct.unpack_from("<I", out, at)[0]), MOST))
    return bytes(out)


def at_rate(data: bytes, to: int) -> bytes:
    """A file's sample counts at another rate, rounded down: the time reference, cue points, regions' lengths and a
    sampler's loops (whose period follows the rate). All else stays, the samples and their format too."""
    parts = _parts(data)
    rate = next(struct.unpack_from("<I", b, 4)[0] for n, b, _ in parts if n == b"fmt ")
    move, out = lambda x: x * to // rate, []
    for name, body, size in parts:
        if name == b"bext" and len(body) >= 346:
            body = body[:338] + struct.pack("<Q", move(struct.unpack_from("<Q", body, 338)[0])) + body[346:]
        elif name == b"cue " and len(body) >= 4:
            body = _counted(body, [4 + 24 * i + k for i in range(min(struct.unpack_from("<I", body)[0], (len(body) - 4) // 24)) for k in (4, 20)], move)
        elif name == b"LIST" and body[:4] == b"adtl":
            body = b"adtl" + b"".join(sub(k, _counted(b, [4], move) if k == b"ltxt" else b) for k, b in entries(body[4:]))
        elif name == b"smpl" and len(body) >= 36:
            loops = min(struct.unpack_from("<I", body, 28)[0], (len(body) - 36) // 24)
            body = _counted(body, [36 + 24 * i + k for i in range(loops) for k in (8, 12)], move)
            body = body[:8] + struct.pack("<I", round(1e9 / to)) + body[12:]
        out.append((name, body, size))
    return rebuilt(data, out)


def patched(files: DataFrame, to_rate: str | None = None) -> DataFrame:
    """Of (path, content, markers, info): path, content and error, with those markers and texts; counts moved to column `to_rate` first, if named."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for content, markers, info, to in zip(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                error = None
                try:
                    content = at_rate(content, to) if to else content
                    content = marked(content, markers, None if info is None else [(x["id"].encode("latin-1"), x["text"]) for x in info])
                except (ValueError, struct.error, StopIteration, TypeError) as e:
                    error = str(e) or "not a WAV file"
                done.append(content)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])

    to = F.col(to_rate).cast("long") if to_rate else F.lit(None).cast("long")
    return files.select("path", "content", "markers", "info", to.alias("to")).mapInArrow(work, "path string, content binary, error string")
