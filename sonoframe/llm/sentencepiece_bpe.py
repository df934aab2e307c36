"""Byte-pair encoding and decoding with a SentencePiece vocabulary, by a merge-type prefix table.

For each prefix of a segment there is exactly one token that the encoding of that prefix can end with. An
Aho-Corasick automaton lists the tokens that end at a position; one is right if it is compatible with the last
token of the prefix before it, that is, if the two tokens' joined text encodes to just those two. The ids are then
read backwards from the last prefix. A segment is a run of spaces and what follows it up to the next space:
no token of the vocabulary crosses such a border, so segments are encoded independently and kept in a bounded memo.

Defined results: a null text counts as empty; an empty text has the begin and end ids only and decodes to the empty
text; characters outside the vocabulary become their UTF-8 bytes' tokens. Every row gives one row, repeated rows
too; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_column

SPACE = "▁"
#: Entries that a generation of a worker's memo may hold, and the characters or ids of the longest.
MEMO, LONGEST = 300_000, 64


class _Memo(dict):
    """A memo of two generations: when the newer is full, it becomes the older and what it doesn't hold goes.

    Long keys aren't kept, so that text without spaces takes no more memory than words do.
    """

    def __init__(self, make, limit: int = MEMO, longest: int = LONGEST):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        if not isinstance(key, int) and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


class Codec:
    """Encodes and decodes with the model in `proto`, the bytes of a SentencePiece BPE model with byte fallback."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.rank = {p: (-sp.get_score(i), i) for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.unknown = sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a token of the vocabulary has a space inside; segments can't be encoded alone")
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.size = len(self.pieces)
        self.widths = [1 if i == self.unknown else len(p) for i, p in enumerate(self.pieces)]
        self.compatible = _Memo(self._compatible, MEMO)
        self.segment = _Memo(self._both)
        self.lines = not any("\n" in p for p in self.rank)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _merged(self, text: str) -> list[str]:
        """The plain definition: of adjacent symbols, again and again, those join whose joined token is best, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((*self.rank[a + b][:1], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        left, right = divmod(pair, self.size)
        a, b = self.pieces[left] if left != self.unknown else "", self.pieces[right]
        return self._merged(a + b) == [x for x in (a, b) if x]

    def _segment(self, segment: str) -> bytes:
        # last[i]: the last token of the prefix of i characters; unknown: its last character is in no token, or i is 0
        compatible, size, unknown = self.compatible, self.size, self.unknown
        last = [unknown] * (len(segment) + 1)
        for at, (token, n) in self.automaton.iter(segment):
            if last[at + 1] == unknown and compatible[last[at + 1 - n] * size + token]:
                last[at + 1] = token
        ids, at, widths = [], len(segment), self.widths
        while at:
            token = last[at]
            if token == unknown:  # the character's bytes, backwards
                ids += [self.bytes[b] for b in reversed(segment[at - 1].encode())]
            else:
                ids.append(token)
            at -= widths[token]
        return array("I", ids[::-1]).tobytes()

    def _both(self, segment: str) -> bytes | tuple[bytes, str]:
        """A segment's ids; and what they decode to, where that isn't the segment again."""
        ids = self._segment(segment)
        text = self._text(ids)
        return ids if text == segment.replace(SPACE, " ") else (ids, text)

    def segments(self, text: str) -> list[bytes | tuple[bytes, str]]:
        """Of each segment of a text what _both says."""
        return [*map(self.segment.__getitem__, self._parts(text))]

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        if self.lines and "  " not in text and SPACE not in text and text[0] != " ":  # no run of spaces: plain splits do
            return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n")).split(" ")
        return self.split(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [self.begin, *array("I", self.joined(text, self.segments(text))[0]), self.end]

    def joined(self, text: str, segments: list[bytes | tuple[bytes, str]]) -> tuple[bytes, str]:
        """The ids of a text's segments, and what they decode to, as decode() would: no character's bytes cross a border,
        so each segment was decoded alone, and most gave themselves again."""
        try:
            return b"".join(segments), text.replace(SPACE, " ")
        except TypeError:
            told = [(x, part.replace(SPACE, " ")) if isinstance(x, bytes) else x for x, part in zip(segments, self._parts(text))]
            return b"".join([ids for ids, _ in told]), "".join([own for _, own in told])[1:]

    def _text(self, ids: bytes) -> str:
        out, held = [], bytearray()
        for i in array("I", ids):
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append("" if i in self.silent else " ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out) + (_utf8(bytes(held)) if held else "")

    def decode(self, ids: Iterable[int]) -> str:
        ids = [i for i in ids if i not in self.silent]
        text = self._text(array("I", ids).tobytes())
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text


def _utf8(raw: bytes) -> str:
    """As the library does: each byte that begins no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at : at + 65536].decode())
            at += 65536
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            at += e.start
            whole = next((n for n in (2, 3, 4) if _valid(raw[at : at + n])), 0)  # a character over the end of a piece
            out.append(raw[at : at + whole].decode() if whole else "�")
            at += whole or 1
    return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[int, Codec] = {}


def codec_of(proto: bytes) -> Codec:
    """The worker's codec for a model: built once, so memos outlive a task."""
    key = hash(proto)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(proto)
    return _codecs[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model file's bytes (0.5 MB): read by the driver and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array, unless ids is false), ids_sha256 and decoded_sha256 of each row; no shuffle."""
    proto = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(proto.value)
        head, tail = array("I", [codec.begin]).tobytes(), array("I", [codec.end]).tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                n, all_ids, sha, back = [], [], [], []
                for text in part.column(1):
                    text = text.as_py()
                    own, decoded = codec.joined(text, codec.segments(text))
                    raw = b"".join((head, own, tail))
                    n.append(len(raw) // 4)
                    sha.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        all_ids.append(array("i", raw))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)] + ([pa.array(all_ids, pa.list_(pa.int32()))] if ids else [])
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if ids else [])
    return text_column(docs.select(F.col(id_col), F.col(text_col).alias("text"))).mapInArrow(work, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), ids=False)
