"""Aligned tokens against the libraries on whole texts, group by group and link by link."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sonoframe.llm import alignment

from .conftest import frame, prose


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    values = alignment.byte_values()
    a_bytes = {i: bytes(values[c] for c in t) for t, i in a.get_vocab().items() if all(c in values for c in t)}
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    return lambda t: [(i, a_bytes[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, b_bytes[i]) for i in b.encode(t)]


def brute_groups(libraries, text):
    if not text:
        return []
    sides = [f(text) for f in libraries]
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
        return []
    ends = []
    for s in sides:
        at, out = 0, []
        for i, x in s:
            at += len(x)
            out.append((i, at))
        ends.append(out)
    out, begun = [], 0
    for cut in sorted({e for _, e in ends[0]} & {e for _, e in ends[1]}):
        out.append(tuple([i for i, e in s if begun < e <= cut] for s in ends))
        begun = cut
    return out


def brute(libraries, docs):
    known = {t: brute_groups(libraries, t) for t in {t for _, t in docs}}
    holders = Counter()
    links = {t: Counter((x, y) for a, b in g for x in a for y in b) for t, g in known.items()}
    for _, t in docs:
        holders.update(links[t].keys())
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for i, t in docs:
        g, own = known[t], links[t]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in own.items() if holders[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * holders[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_on_documents(spark, sf, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(alignment.op11_alignment(spark, sf)) == brute(libraries, docs)


ODD = ["", " ", "  ", " a", "a ", "a  b", "a b", "\n", "a\n b", "a \n b\tc", "x▁y z", "▁", "<|endoftext|> <s></s> <unk>", "日本語 😀 ends", "é́  x", " y  z", "can't won't 's", "\x00 \x1c a\x85b", "don 't", "!!! ???", "a" * 3000, "Ġ Ċ", "1234567 89", "ﬁ ﬂ ½ ™", "​ a​"]


def test_odd_texts_and_rows(spark, libraries):
    rng = random.Random(4)
    bits = [" ", " ", "a", "b", "Z", "é", "▁", "\n", "\t", "1", ".", "'s", "😀", "日", " ", "　", "word", "ing", "́", "<s>"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 20)))) for i in range(400)]
    docs += [(None, "no id here"), (None, "no id here"), (7, None), (7, "seven again"), (3, ODD[3]), (900, prose(1, 3000)), (901, prose(1, 3000))]
    assert rows(alignment.alignments(frame(spark, docs).repartition(3))) == brute(libraries, docs)
    assert alignment.alignments(frame(spark, [])).count() == 0


def test_small_runs_batches_and_memo(libraries, monkeypatch):
    """The machine in small steps gives the same groups, and links of wide groups the same counts."""
    import numpy as np

    both = alignment.Tokenizers(alignment.byte_level_json(), alignment.model_bytes())
    monkeypatch.setattr(alignment, "MEMO", 10)
    texts = [prose(i, 80) + "é日本" * (i % 3) for i in range(30)]
    for k, (text, ids) in enumerate(zip(texts, [x for i in range(0, 30, 5) for x in both.encode(texts[i : i + 5])])):
        events = []
        for side in (0, 1):
            at = np.concatenate([[0], np.cumsum(both.lengths[side][ids[side]])])
            events += [(k, b"", int(at[j]), side, 1, ids[side][j : j + 3].tobytes()) for j in range(0, len(ids[side]), 3)]
        events = [e for e in sorted(events, key=lambda e: e[2:4]) for _ in range(1 + k % 2)]  # repeated rows too
        runs = list(alignment.sweep(events, both.lengths, both.kind))
        assert runs.pop()[1] is None and runs[0][0].copies == 1 + k % 2
        groups = [(list(a), list(b)) for _, r in runs for a, b in zip(np.split(r.a, np.cumsum(r.n_a)[:-1]), np.split(r.b, np.cumsum(r.n_b)[:-1]))]
        want = brute_groups(libraries, text)
        assert groups == want
        whole = alignment.Run(*ids, *[np.array([len(g[s]) for g in want]) for s in (0, 1)])
        names = alignment.numerals(51000)
        assert whole.text(names) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want).encode()
        for wide in (0, 1, 10**9):
            monkeypatch.setattr(alignment, "WIDE", wide)
            found = Counter()
            for a, b, n in zip(*whole.links()):
                found[int(a), int(b)] += int(n)
            assert found == Counter((x, y) for a, b in want for x in a for y in b)


def test_groups_agree_with_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = rows(alignment.alignments(docs))
    groups = Counter(r["doc_id"] for r in alignment.aligned_groups(docs).collect())
    assert groups == Counter({r[0]: r[3] for r in want if r[3]})


def test_groups_are_rows(spark, libraries):
    docs = [(1, prose(5, 40)), (2, ""), (3, "x▁y"), (1, "another text of one id")]
    found = defaultdict(list)
    for r in sorted(alignment.aligned_groups(frame(spark, docs)).collect(), key=lambda r: r["number"]):
        found[r["doc_id"], bytes(r["digest"])].append((r["a"], r["b"]))
    assert found == {(i, hashlib.md5(t.encode()).digest()): brute_groups(libraries, t) for i, t in docs if brute_groups(libraries, t)}
