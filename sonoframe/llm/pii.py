"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The model is trained here, in numpy on the driver, from windows of at most SAMPLE labelled ones: their labels are the
base patterns' spans, half of them rewritten into forms that the patterns don't know (phone numbers without a
country code; signs and dots of addresses apart or in brackets; cards in other groups). Every kind has a digit or an at sign, so text away from both needs no model:
windows of 64 characters, half overlapping, cover the surroundings of those characters in every whole text. Where
windows overlap their emissions are averaged, and one Viterbi pass decodes the whole region, so that a span across
windows is found once. A span of the model's counts if it has what its kind must have and touches no base span.

Defined results: null texts count as empty; texts without personal data have zero counts and an empty list; every
row gives one row. Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, text_column

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE = 64, 32
#: Labelled windows that the model is trained on, at most; documents that they come from, about.
SAMPLE, SAMPLE_DOCS = 3000, 4000
#: Forms in which a sampled text with personal data is shown.
VARIANTS = 8
EMBED, HIDDEN, STEPS, BATCH = 12, 16, 400, 48

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS, _DIGIT, _WORD = re.compile("[^0-9]+"), re.compile("[0-9]"), re.compile("[a-z]{2,10}")
#: What the model's addresses must be: an at sign or a dot may stand apart or in brackets.
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+[\x20\[(]*@[\x20\])]*[A-Za-z0-9-]+(?:[\x20\[(]*\.[\x20\])]*[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"([0-9]+)" + r"[\x20\[(]*\.[\x20\])]*([0-9]+)" * 3)


def luhn(digits: str) -> bool:
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, leftmost and not overlapping within a kind, in order."""
    out, cursor = [], 0
    for m in _AT.finditer(text):  # the local part is what stands before the at sign, as far as the last match
        start = m.start()
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            cursor = m.end()
    small = lambda part: len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def codes(text: str) -> np.ndarray:
    """Printable ASCII as 1 to 95, newline 96, other letters 97, the rest 98; 0 is left for what is outside a text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points == 10, 96, np.where(points > 191, 97, 98))).astype(np.uint8)


def regions(code: np.ndarray) -> list[tuple[int, int]]:
    """(start, windows) of the parts of a text that need the model; windows cover it from start on."""
    at = np.flatnonzero(((code >= 17) & (code <= 26)) | (code == 33))
    if not len(at):
        return []
    room = np.where(code[at] == 33, WINDOW, STRIDE // 2)  # local parts and domains are long and may have no digit
    lo, hi = np.minimum.accumulate((at - room)[::-1])[::-1], np.maximum.accumulate(at + room)
    edge = np.flatnonzero(lo[1:] - hi[:-1] > STRIDE) + 1
    lo, hi = lo[np.concatenate([[0], edge])], hi[np.concatenate([edge - 1, [len(at) - 1]])]
    return [(int(a), max(1, -(-int(b - a - STRIDE) // STRIDE))) for a, b in zip(lo, hi)]


def cut(code: np.ndarray, start: int, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.uint8)
    a, b = max(start, 0), min(start + size, len(code))
    if b > a:
        out[a - start : b - start] = code[a:b]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """The network: embeddings, an LSTM each way, emissions, and a linear-chain CRF over tags."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        weight = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": weight(99, EMBED), "out": weight(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": weight(EMBED, 4 * HIDDEN), f"h{way}": weight(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates begin open

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """The LSTM's outputs over x (batch, time, embed) from first to last; keep gets what its gradient needs."""
        n, steps = x.shape[:2]
        into = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, steps, HIDDEN), np.float32)
        for t in range(steps):
            z = into[:, t] + h @ self.p[f"h{way}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[:, t] = h
            if keep is not None:
                keep.append((h_before, before, i, f, o, g, squashed))
        return out

    def emissions(self, code: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.p["embed"][code]
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._run(x, "f", kept["f"]), self._run(x[:, ::-1], "b", kept["b"])[:, ::-1]], axis=2)
        if keep is not None:
            keep.update(x=x, h=h, **kept)
        return h @ self.p["out"] + self.p["bias"]

    def _back(self, x: np.ndarray, d_out: np.ndarray, way: str, kept: list, grads: dict) -> np.ndarray:
        d_in = np.empty((*d_out.shape[:2], 4 * HIDDEN), np.float32)
        d_h, d_c = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
        for t in reversed(range(d_out.shape[1])):
            h_before, before, i, f, o, g, squashed = kept[t]
            d_h = d_h + d_out[:, t]
            d_c = d_c + d_h * o * (1 - squashed**2)
            z = d_in[:, t]
            z[:, :HIDDEN] = d_c * g * i * (1 - i)
            z[:, HIDDEN : 2 * HIDDEN] = d_c * before * f * (1 - f)
            z[:, 2 * HIDDEN : 3 * HIDDEN] = d_h * squashed * o * (1 - o)
            z[:, 3 * HIDDEN :] = d_c * i * (1 - g**2)
            grads[f"h{way}"] += h_before.T @ z
            d_h, d_c = z @ self.p[f"h{way}"].T, d_c * f
        flat = d_in.reshape(-1, 4 * HIDDEN)
        grads[f"x{way}"] += x.reshape(-1, EMBED).T @ flat
        grads[f"b{way}"] += flat.sum(0)
        return d_in @ self.p[f"x{way}"].T

    def gradients(self, code: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """The mean negative log-likelihood of tag sequences, and its gradient by parameter."""
        keep: dict = {}
        emit = self.emissions(code, keep).astype(np.float64)
        step, (n, steps) = self.p["step"].astype(np.float64), code.shape
        add = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, steps):
            ahead[:, t] = add(ahead[:, t - 1][:, :, None] + step, 1) + emit[:, t]
        for t in range(steps - 2, -1, -1):
            behind[:, t] = add(step + (behind[:, t + 1] + emit[:, t + 1])[:, None, :], 2)
        whole = add(ahead[:, -1], 1)
        d_emit = np.exp(ahead + behind - whole[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - whole[:, None, None, None]).sum((0, 1))
        rows, times = np.arange(n)[:, None], np.arange(steps)
        gold = emit[rows, times, tags].sum(1) + step[tags[:, :-1], tags[:, 1:]].sum(1)
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1)
        d_emit[rows, times, tags] -= 1
        d_emit = (d_emit / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["step"] = (pair / n).astype(np.float32)
        grads["out"] = keep["h"].reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS)
        grads["bias"] = d_emit.sum((0, 1))
        d_h = d_emit @ self.p["out"].T
        d_x = self._back(keep["x"], d_h[:, :, :HIDDEN], "f", keep["f"], grads)
        d_x = d_x + self._back(keep["x"][:, ::-1], d_h[:, ::-1, HIDDEN:], "b", keep["b"], grads)[:, ::-1]
        np.add.at(grads["embed"], code, d_x)
        return float((whole - gold).mean()), grads

    def train(self, code: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.01, seed: int = 3) -> float:
        """Adam on random batches; the last batches' mean loss."""
        rng, first, second, losses = np.random.default_rng(seed), {}, {}, []
        for t in range(1, steps + 1):
            own = rng.integers(0, len(code), min(BATCH, len(code)))
            loss, grads = self.gradients(code[own], tags[own])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                self.p[k] = self.p[k] - (rate * min(1, 2 - 2 * t / (steps + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """The best tag sequences (batch, time) of emissions."""
        best, back = emit[:, 0], np.empty(emit.shape, np.int8)
        for t in range(1, emit.shape[1]):
            total = best[:, :, None] + self.p["step"]
            back[:, t] = total.argmax(1)
            best = np.take_along_axis(total, back[:, t][:, None, :].astype(np.int64), 1)[:, 0] + emit[:, t]
        tags = np.empty(emit.shape[:2], np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(emit.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(tags)), t, tags[:, t]]
        return tags

    def tag(self, parts: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
        """The tags of regions (a text's codes, start, windows): overlapping windows' emissions are averaged, then decoded once."""
        out: list = [None] * len(parts)
        windows: dict[int, list[int]] = {}
        for i, (_, _, n) in enumerate(parts):
            windows.setdefault(n, []).append(i)
        for n, own in windows.items():
            for first in range(0, len(own), max(1, 1024 // n)):
                some = own[first : first + max(1, 1024 // n)]
                size = STRIDE * (n + 1)
                code = np.stack([cut(parts[i][0], parts[i][1], size) for i in some])
                each = np.lib.stride_tricks.sliding_window_view(code, WINDOW, axis=1)[:, ::STRIDE].reshape(-1, WINDOW)
                emit = np.concatenate([self.emissions(each[a : a + 1024]) for a in range(0, len(each), 1024)]).reshape(len(some), n, WINDOW, TAGS)
                total, count = np.zeros((len(some), size, TAGS), np.float32), np.zeros((size, 1), np.float32)
                for w in range(n):
                    total[:, w * STRIDE : w * STRIDE + WINDOW] += emit[:, w]
                    count[w * STRIDE : w * STRIDE + WINDOW] += 1
                for i, tags in zip(some, self.decode(total / count)):
                    out[i] = tags
        return out


def tagged(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of runs of one kind that begin at a begin tag."""
    out, kind, start = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        if kind >= 0 and t != 2 + 2 * kind:
            out.append((kind, start, i))
            kind = -1
        if t % 2 == 1:
            kind, start = t // 2, i
    return out


def _plausible(kind: int, text: str) -> bool:
    """Whether a span of the model's has what its kind must have."""
    if kind == 0:
        return _MAIL.fullmatch(text) is not None
    if kind == 1:
        return (m := _PARTS.fullmatch(text)) is not None and all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.groups())
    digits = _DIGITS.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """A form of the same datum that the base patterns don't know."""
    digits = _DIGITS.sub("", text)
    if kind == 3 and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")[rng.integers(3)]
    if kind == 0:
        return text.replace("@", (" @ ", " [@] ", "(@)", "@ ")[rng.integers(4)], 1)
    if kind == 1:
        return text.replace(".", ("[.]", " . ", "(.)", ". ")[rng.integers(4)])
    if kind == 2:
        mark = (".", "/", "_", "  ")[rng.integers(4)]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return text


def another(kind: int, text: str, words: list[str], rng: np.random.Generator) -> str:
    """A datum of the same kind with other letters and digits; an address is made of the document's words."""
    if kind == 0:
        word = lambda: words[rng.integers(len(words))] if words else "x"
        local = "".join((word(), ("", ".", "_", "-")[rng.integers(4)], word() if rng.random() < 0.4 else "", str(rng.integers(1000)) if rng.random() < 0.4 else ""))
        return f"{local}@{word()}{('', '-', '.')[rng.integers(3)]}{word()}.{('com', 'org', 'net', 'co.uk', 'example', 'de')[rng.integers(6)]}"
    if kind == 1:
        return ".".join(map(str, rng.integers(0, 256, 4)))
    return _DIGIT.sub(lambda _: str(rng.integers(10)), text)


def samples(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of at most SAMPLE windows around digits and at signs, VARIANTS of each text with personal data.

    In the first variant the spans are as they are; in the others they have other letters and digits, and half of
    them stand in other forms, some between brackets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                rng, spans = np.random.default_rng(abs(doc or 0)), sorted(base_spans(text), key=lambda x: x[1])
                words = _WORD.findall(text) if spans else []
                for variant in range(VARIANTS if spans else 1):
                    made, tags, at = [], [], 0
                    for kind, a, b in spans:
                        if a >= at:
                            new = another(kind, text[a:b], words, rng) if variant else text[a:b]
                            new = rewritten(kind, new, rng) if variant and rng.random() < 0.6 else new
                            left, right = (("(", ")"), ("", ","), (" ", "\n"), ("", ""))[rng.integers(4)] if variant and new[0] != "(" else ("", "")
                            made += [text[at:a], left, new, right]
                            tags += [np.zeros(a - at + len(left), np.int8), np.full(len(new), 2 + 2 * kind, np.int8), np.zeros(len(right), np.int8)]
                            tags[-2][0] = 1 + 2 * kind
                            at = b
                    code = codes("".join([*made, text[at:]]))
                    tag = np.concatenate([*tags, np.zeros(len(text) - at, np.int8)])
                    for start, n in regions(code):
                        begin = start + STRIDE * int(rng.integers(n)) + int(rng.integers(-16, 17))
                        ids.append(doc)
                        parts.append(cut(code, begin, WINDOW).tobytes() + cut(tag.astype(np.uint8), begin, WINDOW).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "window"])

    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    rows = some.mapInArrow(work, "doc_id long, window binary").orderBy(F.xxhash64("window"), "window").limit(SAMPLE).collect()
    both = np.array([np.frombuffer(r["window"], np.uint8) for r in rows]).reshape(-1, 2 * WINDOW)
    return both[:, :WINDOW], both[:, WINDOW:].astype(np.int64)


def _union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends, in order, of the stretches that spans (kind, start, end) cover together."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(covered: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether a stretch has a character of a to b: the last that starts before b ends after a."""
    at = bisect_left(covered[0], b) - 1
    return a < b and at >= 0 and covered[1][at] > a


def spans(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, n_model, base_sha256 and spans (kind:start:end by kind, then start) of each row."""
    docs = text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    if tagger is None:
        tagger = Tagger()
        code, tags = samples(docs)
        if len(code):
            tagger.train(code, tags)
    model = docs.sparkSession.sparkContext.broadcast(tagger.p)
    marks = np.zeros(256, dtype=bool)
    marks[[*range(48, 58), 64]] = True
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "n_model", "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger()
        own.p = model.value
        write = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                marked = np.concatenate([[0], np.cumsum(marks[data])])
                busy = np.flatnonzero(np.diff(marked[offsets]))
                found: list[list] = [[] for _ in range(part.num_rows)]
                covered: dict[int, tuple[list[int], list[int]]] = {}
                base, texts, parts, whose = [[]] * part.num_rows, {}, [], []
                for i in busy.tolist():
                    texts[i] = text = part.column(1)[i].as_py()
                    base[i] = base_spans(text)
                    covered[i] = _union(base[i])
                    code = codes(text)
                    for start, n in regions(code):
                        parts.append((code, start, n))
                        whose.append(i)
                for i, (_, start, _), tags in zip(whose, parts, own.tag(parts)):
                    for kind, a, b in tagged(tags) if tags.any() else ():
                        a, b = max(start + a, 0), min(start + b, len(texts[i]))
                        if _plausible(kind, texts[i][a:b]) and not _meets(covered[i], a, b):
                            found[i].append((kind, a, b))
                counts = np.zeros((len(KINDS), part.num_rows), dtype=np.int64)
                for i in busy.tolist():
                    for kind, _, _ in base[i]:
                        counts[kind, i] += 1
                columns = [part.column(0), *map(pa.array, counts), pa.array([len(x) for x in found], pa.int64())]
                columns += [pa.array([hashlib.sha256(write(x).encode()).hexdigest() for x in base]), pa.array([write(sorted([*x, *y])) for x, y in zip(base, found)])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(work, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_model long, base_sha256 string, spans string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(read_table(spark, sf_dir, "documents"))
