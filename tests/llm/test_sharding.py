"""Places by the permutation: bijections, gapless slots, independence of the input's order, and written shards."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonoframe.llm import sharding

from .conftest import frame, prose


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000, 4096, 4097])
def test_permutation_of_every_number(n):
    p = sharding.Permutation(n, seed=3)
    x = np.arange(n)
    assert sorted(p.place(x)) == list(range(n)) and (p.row(p.place(x)) == x).all()


def test_permutation_of_large_numbers_goes_back():
    p = sharding.Permutation(10**15 + 37, seed=1)
    x = np.random.default_rng(0).integers(0, p.n, 1000)
    assert (p.row(p.place(x)) == x).all() and p.place(x).max() < p.n


def test_permutation_mixes():
    p = sharding.Permutation(16_000)
    shard = p.place(np.arange(16_000)) % 16
    near = Counter(zip(shard[:-1], shard[1:]))
    assert len(near) == 256 and max(near.values()) < 120  # 62.5 each
    other = sharding.Permutation(16_000, seed=1).place(np.arange(16_000))
    assert (other == p.place(np.arange(16_000))).sum() < 20


def gapless(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_places(spark, edge, none, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 3)
    rows = sharding.places(edge, 4).collect()
    texts = {(r["doc_id"], r["text"] or "") for r in edge.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts}
    gapless(rows, 4)
    again = sharding.places(edge.repartition(7), 4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.places(none, 4).count() == 0


def test_a_row_repeated_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    docs = frame(spark, [(None, "one and the same")] * 2500 + [(i, prose(i, 5)) for i in range(50)])
    rows = sharding.places(docs, 16).collect()
    gapless(rows, 16)
    assert sum(r["doc_id"] is None for r in rows) == 2500


def test_written_shards_are_in_the_order_of_slots(spark, edge, tmp_path):
    sharding.write_shards(edge, str(tmp_path / "shards"), 3, seed=5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    rows = back.collect()
    gapless(rows, 3)
    strip = lambda r: tuple(r[c] for c in edge.columns)
    assert sorted(map(str, map(strip, rows))) == sorted(map(str, map(strip, edge.collect())))
    for folder in (tmp_path / "shards").glob("shard=*"):
        for file in folder.glob("*.parquet"):
            slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
            assert slots == sorted(slots)


def test_columns_named_shard_and_slot_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x", {"k": 1}), (1, "a", "x", {"k": 2}), (2, None, "y", None)], "doc_id long, text string, shard string, extra map<string, int>")
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    rows = spark.read.parquet(str(tmp_path / "s")).collect()
    gapless(rows, 2)
    assert sorted(str(r["extra"]) for r in rows) == ["None", "{'k': 1}", "{'k': 2}"]
