"""Alignment of two tokenizers' tokens by an event sweep over the byte offsets at which tokens end.

Every token of either tokenizer is an end event at a byte offset of its document. The events of both sides are one
table, dealt by document and sorted by offset within partitions; a machine passes over it once. It holds the tokens
since the last offset at which both sides end; where both end again, it emits them as a group. All pairs of a group's
A and B tokens are links. An event row carries a run of up to CHUNK consecutive tokens of one side, whose ends follow
from their lengths, so that an event takes two bytes and not a row; the machine's state is at most two runs and the
open group, however long a document is.

A pair's count, over documents, is a sum over dictionaries: documents are put into batches of bounded size, each with
the distinct pairs of its documents and how many hold them. Batches ask for the counts of their pairs by one join;
nothing of a single link is shuffled.

Texts are encoded piece by piece, cut at single spaces between characters that aren't white space: no token of the two
vocabularies crosses such a place. Pieces' ids stay in a bounded memo.

Defined results: documents whose text is null or empty, or whose tokens of either side don't join to space and text,
have no tokens: zeros and empty columns. Rows without an id are documents too; rows of equal id and text are encoded
once and counted as often as they stand; no rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, slices, text_column
from .sentencepiece_bpe import SPACE, model_bytes

#: Tokens of one event row.
CHUNK = 16_384
#: Distinct pairs of documents, counted for each document, that close a batch.
BATCH_PAIRS = 4_000_000
#: Pieces that each of a memo's two generations holds, and the characters of the longest.
MEMO, LONGEST = 250_000, 64
#: Bytes of text whose new pieces are encoded by one call.
STEP_BYTES = 1 << 21
#: A group of more links is counted by its distinct ids.
WIDE = 65_536
A, B = 0, 1


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers: a byte-level BPE in the tokenizers library's JSON (A) and a SentencePiece model (B)."""

    def __init__(self, byte_level: str, proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        values = byte_values()
        size = self.a.get_vocab_size()
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.kind = np.dtype("<u2" if max(size, len(pieces)) <= 1 << 16 else "<u4")
        self.lengths = [np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.newer: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[bytes | None, bytes | None]]:
        """Packed ids of both sides of each piece after a space; None if a side doesn't join to that."""
        if not pieces:
            return
        a = self.a.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)
        for piece, x, y in zip(pieces, a, self.b.encode(pieces, num_threads=1)):
            whole, x = f" {piece}".encode(), x.ids
            if b"".join([self.a_bytes[i] for i in x]) == whole == b"".join([self.b_bytes[i] for i in y]):
                yield np.array(x, self.kind).tobytes(), np.array(y, self.kind).tobytes()
            else:
                yield None, None

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides of each text; None if it has no tokens."""
        if len(self.newer) > MEMO:
            self.older, self.newer = self.newer, {}
        split = [self.split(t) if t else [] for t in texts]
        missing = []
        for piece in set().union(*split).difference(self.newer):
            if (known := self.older.get(piece)) is None:
                missing.append(piece)
            else:
                self.newer[piece] = known
        self.newer.update(zip(missing, self._encoded(missing)))
        for pieces in split:
            both = [self.newer[p] for p in pieces]
            if not both or any(x is None for x, _ in both):
                yield None
            else:
                yield tuple(np.frombuffer(b"".join([x[side] for x in both]), self.kind) for side in (A, B))
        for piece in missing:
            if len(piece) > LONGEST:
                self.newer.pop(piece, None)


_held: dict[int, Tokenizers] = {}


def _tokenizers(byte_level: str, proto: bytes) -> Tokenizers:
    """The worker's tokenizers: built once, so memos outlive a task."""
    key = hash((byte_level, proto))
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizers(byte_level, proto)
    return _held[key]


def byte_level_json(path: str | None = None) -> str:
    """The vocabulary file's text (2 MB): read by the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


_EVENTS = "doc_id long, digest binary, at long, side int, copies long, ids binary"


def events(docs: DataFrame, files) -> DataFrame:
    """The end events of both sides of (doc_id, text), in runs: digest of the text, byte offset of the run's start, side,
    packed ids. A document's first row has `copies`, the equal rows that were met with it; without tokens, no ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*files.value)
        for batch in batches:
            for part, _, _ in slices(batch, "text", STEP_BYTES):
                texts = part.column(1).to_pylist()
                met = Counter((i, hashlib.md5(t.encode()).digest(), t) for i, t in zip(part.column(0).to_pylist(), texts))
                rows: list[tuple] = []
                for (doc, digest, _), copies, ids in zip(met, met.values(), both.encode([t for _, _, t in met])):
                    if ids is None:
                        rows.append((doc, digest, 0, A, copies, None))
                        continue
                    for side in (A, B):
                        at = np.concatenate([[0], np.cumsum(both.lengths[side][ids[side]])])
                        rows += [(doc, digest, int(at[k]), side, copies, ids[side][k : k + CHUNK].tobytes()) for k in range(0, len(ids[side]), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["doc_id", "digest", "at", "side", "copies", "ids"]
    return docs.mapInArrow(work, _EVENTS)


def in_order(rows: DataFrame) -> DataFrame:
    """Events dealt by document, in order of their offsets."""
    return rows.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "at", "side")


class Run:
    """Consecutive whole groups of one document: the ids of both sides and how many of them each group has."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A id, B id and times of the pairs; a pair may come more than once."""
        wide = self.n_a * self.n_b > WIDE
        n_b = np.where(wide, 0, self.n_b)
        each = np.repeat(n_b, self.n_a)  # links of each A token
        first = np.repeat(np.cumsum(self.n_b) - self.n_b, self.n_a)
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        a, b = np.repeat(self.a, each), self.b[np.repeat(first, each) + within]
        times = np.ones(len(a), dtype=np.int64)
        for g in np.flatnonzero(wide):
            x, n_x = np.unique(self.a[(e := self.n_a[: g + 1].sum()) - self.n_a[g] : e], return_counts=True)
            y, n_y = np.unique(self.b[(e := self.n_b[: g + 1].sum()) - self.n_b[g] : e], return_counts=True)
            a, b = np.append(a, np.repeat(x, len(y))), np.append(b, np.tile(y, len(x)))
            times = np.append(times, np.repeat(n_x, len(y)) * np.tile(n_y, len(x)))
        return a, b, times

    def text(self, numerals: tuple[np.ndarray, np.ndarray]) -> bytes:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        shown, width = numerals
        n, end_a, end_b = len(self.a) + len(self.b), np.cumsum(self.n_a), np.cumsum(self.n_b)
        ids, mark = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        ids[np.arange(len(self.a)) + np.repeat(end_b - self.n_b, self.n_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(end_a, self.n_b)] = self.b
        mark[end_a + end_b - self.n_b - 1] = ord("|")
        mark[end_a + end_b - 1] = ord(";")
        out, wide = shown[ids], width[ids]
        out[np.arange(n), wide] = mark
        return out[np.arange(out.shape[1]) <= wide[:, None]].tobytes()[:-1]


def numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. size - 1, from the left, and how many there are."""
    names = [str(i).encode() for i in range(size)]
    width = np.array([len(x) for x in names])
    table = np.zeros((size, width.max() + 1), dtype=np.uint8)
    for i, x in enumerate(names):
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
    return table, width


class Document:
    """A document's head; its groups come as runs."""

    def __init__(self, doc_id: int | None, digest: bytes):
        self.doc_id, self.digest, self.copies = doc_id, digest, 0


def sweep(rows: Iterable[tuple], lengths: list[np.ndarray], kind: np.dtype) -> Iterator[tuple[Document, Run | None]]:
    """The machine: of event rows in order, each document's runs of groups, and (document, None) at its end."""
    doc = last = None
    ids: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    for doc_id, digest, at, side, copies, packed in rows:
        if doc is None or (doc_id, digest) != (doc.doc_id, doc.digest):
            if doc is not None:
                yield doc, None
            doc, last = Document(doc_id, digest), None
            ids, ends = [np.zeros(0, kind)] * 2, [np.zeros(0, np.int64)] * 2
        if (at, side) == (0, A):
            doc.copies += copies
        if packed is None or (at, side) == last:  # an equal row, met in another task
            continue
        last = at, side
        new = np.frombuffer(packed, kind)
        ids[side] = np.concatenate([ids[side], new])
        ends[side] = np.concatenate([ends[side], at + np.cumsum(lengths[side][new])])
        both = np.intersect1d(ends[A], ends[B], assume_unique=True)
        if not len(both):
            continue
        to = [np.searchsorted(e, both) + 1 for e in ends]
        yield doc, Run(ids[A][: to[A][-1]], ids[B][: to[B][-1]], *[np.diff(t, prepend=0) for t in to])
        ids, ends = ([x[s][to[s][-1] :] for s in (A, B)] for x in (ids, ends))
    if doc is not None:
        yield doc, None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _files(docs: DataFrame, byte_level: str | None, model: str | None):
    return docs.sparkSession.sparkContext.broadcast((byte_level_json(byte_level), model_bytes(model)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def aligned_groups(docs: DataFrame, byte_level: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (MD5 of the text), first (number of the group), a and b (arrays of ids), one row for each group.

    Rows of equal id and text give their groups once.
    """
    files = _files(docs, byte_level, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, met, n = _tokenizers(*files.value), None, 0
        for doc, run in sweep(_rows(batches), both.lengths, both.kind):
            n = n if doc is met else 0
            met = doc
            if run is not None:
                g = len(run.n_a)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), pa.array(x.astype(np.int32))) for x, k in ((run.a, run.n_a), (run.b, run.n_b))]
                yield pa.RecordBatch.from_arrays([pa.array([doc.doc_id] * g, pa.int64()), pa.array([doc.digest] * g, pa.binary()), pa.array(np.arange(n, n + g)), *lists], ["doc_id", "digest", "number", "a", "b"])
                n += g

    return in_order(events(_texts(docs, id_col, text_col), files)).mapInArrow(work, "doc_id long, digest binary, number long, a array<int>, b array<int>")


class _Batch:
    """Documents of a batch: their distinct pairs, and the batch's dictionary."""

    NAMES = ["batch", "doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "dictionary", "holders"]
    SCHEMA = "batch long, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, dictionary binary, holders binary"
    TYPES = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * 4
    ROWS = 256

    def __init__(self, number: int):
        self.number, self.rows, self.size = number, [], 0
        self.pairs: list[np.ndarray] = []
        self.copies: list[int] = []

    def add(self, doc: Document, n: list[int], sha: str, pairs: np.ndarray, times: np.ndarray) -> None:
        small = "<u2" if times.max(initial=0) < 1 << 16 else "<u8"
        self.rows.append((self.number, doc.doc_id, doc.copies, *n, sha, pairs.tobytes(), times.astype(small).tobytes(), None, None))
        self.pairs.append(pairs)
        self.copies.append(doc.copies)
        self.size += len(pairs)

    def some(self, every: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= every:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.TYPES)], self.NAMES)
            self.rows = []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
            holders = np.bincount(at, weights=np.repeat(self.copies, [len(p) for p in self.pairs])).astype("<i8")
            self.rows.append((self.number, *[None] * 9, pairs.tobytes(), holders.tobytes()))
        yield from self.some()


def _compact(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their times."""
    if not found:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    return pairs, np.bincount(at, weights=np.concatenate([t for _, t in found])).astype(np.int64)


def alignments(docs: DataFrame, byte_level: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    files = _files(docs, byte_level, model)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*files.value)
        shift, kind = (16, np.dtype("<u4")) if both.kind.itemsize == 2 else (32, np.dtype("<u8"))
        names = numerals(max(map(len, both.lengths)))
        number = TaskContext.get().partitionId() << 32
        batch, met, sha, n, found = _Batch(number), None, None, [0] * 4, []
        for doc, run in sweep(_rows(batches), both.lengths, both.kind):
            if doc is not met:
                met, sha, n, found = doc, None, [0] * 4, []
            if run is not None:
                a, b, times = run.links()
                found.append((a.astype(kind) << kind.type(shift) | b.astype(kind), times))
                if sum(len(p) for p, _ in found) > BATCH_PAIRS:
                    found = [_compact(found)]
                n = [x + int(y) for x, y in zip(n, (len(run.a), len(run.b), len(run.n_a), (run.n_a * run.n_b).sum()))]
                if sha is None:
                    sha = hashlib.sha256()
                else:
                    sha.update(b";")
                sha.update(run.text(names))
                continue
            batch.add(doc, n, sha.hexdigest() if sha else "", *_compact(found))
            yield from batch.some(_Batch.ROWS)
            if batch.size >= BATCH_PAIRS or len(batch.copies) >= BATCH_PAIRS >> 6:
                yield from batch.close()
                number += 1
                batch = _Batch(number)
        yield from batch.close()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _tokenizers(*files.value).kind
        for batch in batches:
            for number, pairs, holders in _rows([batch]):
                pairs, holders = np.frombuffer(pairs, f"<u{2 * kind.itemsize}"), np.frombuffer(holders, "<i8")
                for k in range(0, len(pairs), 100_000):
                    part = pairs[k : k + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(part), pa.array(holders[k : k + 100_000])], ["batch", "pair", "n"])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        sums, tops = [], []
        for pairs, times, size in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist(), left.column("n_links").to_pylist()):
            if not size:
                sums.append(0)
                tops.append(0)
                continue
            pairs = np.frombuffer(pairs, kind)
            times = np.frombuffer(times, "<u2" if len(times) == 2 * len(pairs) else "<u8").astype(np.int64)
            at = np.searchsorted(pair, pairs)
            sums.append(int((count[at] * times).sum()))
            tops.append(int(times[best[at]].sum()))
        return pa.table([*[left.column(c) for c in kept[:6]], pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), left.column("groups_sha256")], kept)

    kept = ["doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    both = Tokenizers(*files.value)
    shift, kind = (16, "<u4") if both.kind.itemsize == 2 else (32, "<u8")
    whole = materialise(in_order(events(_texts(docs, id_col, text_col), files)).mapInArrow(summaries, _Batch.SCHEMA), "aligned")
    asked = whole.where("dictionary is not null").select("batch", "dictionary", "holders").mapInArrow(entries, "batch long, pair long, n long")
    counts = materialise(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    best = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.max("count").alias("most"))  # as many as A's vocabulary at most
    marked = counts.withColumn("a", F.shiftright("pair", shift)).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("batch", "pair").join(marked, "pair").select("batch", "pair", "count", "best")
    rows = whole.where("dictionary is null").select("batch", *kept[:6], "pairs", "times", "groups_sha256")
    out = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(answered, "doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    # equal rows again, in two steps that need no long array
    out = out.withColumn("_first", F.explode(F.expr("sequence(1L, copies, 10000L)"))).withColumn("_copy", F.explode(F.expr("sequence(_first, least(_first + 9999L, copies))")))
    return out.select(*[c for c in kept if c != "copies"])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(read_table(spark, sf_dir, "documents"))
