"""Hard negatives against exact scores of all pairs, and on odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sonoframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score double, block string"


def mined(spark, rows):
    anchor = F.col("vec_id") % 5 == 0
    frame = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(frame, anchor).collect())


def brute(rows, every=5):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
    out = []
    for a in (i for i in kept if i % every == 0):
        ranked = sorted((i for i in kept if i != a), key=lambda i: (-score(a, i), i))
        for p in [i for i in ranked if kept[i][0] == kept[a][0]][:5]:
            inside = [i for i in ranked if kept[i][0] != kept[a][0] and 50 * score(a, p) <= 100 * score(a, i) <= 95 * score(a, p)]
            out += [(a, p, k, i, score(a, p), score(a, i)) for k, i in enumerate(inside[:3], 1)]
    return sorted(out)


def points(n, dims, seed, spread=0.1):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.gauss(0.1, spread) for _ in range(dims)]) for i in range(n)]


def test_equal_to_all_pairs(spark):
    rows = points(300, 12, 1)
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(40)]  # one vector under many ids: ties
    assert mined(spark, rows) == brute(rows) != []


def test_tiles_of_any_size_agree(spark, monkeypatch):
    rows = points(200, 8, 2)
    whole = mined(spark, rows)
    for name, value in (("ROWS", 30), ("ANCHORS", 9), ("ROW_STEP", 7), ("ANCHOR_STEP", 3), ("SAMPLE", 5)):
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, rows) == whole == brute(rows)


def test_odd_rows(spark):
    rows = points(60, 6, 3)
    odd = [(None, 1, rows[0][2]), (501, None, rows[0][2]), (502, 1, None), (503, 1, [0.1, None]), (504, 1, [float("nan")] * 6), (505, 1, [float("inf")] * 6)]
    repeated = [rows[7], rows[7], (7, 9, rows[3][2])]
    short = [(600, 1, [0.5]), (601, 2, []), (605, 2, [-3.0, 0.0, 2.5, 100.0, -0.001, 0.3])]
    whole = rows + odd + repeated + short
    assert mined(spark, whole) == brute(whole)
    assert mined(spark, []) == [] and mined(spark, odd) == [] and mined(spark, rows[:1]) == []


def test_large_components_are_scored_exactly(spark):
    rows = [(i, i % 2, [1000.0 * (i + 1), 2.0**20 / (1 + i % 4), -900_000.0 / (1 + i % 3)]) for i in range(20)] + [(99, 0, [3e38, 0.0, 0.0])]
    found = mined(spark, rows[:-1])
    assert found == brute(rows[:-1]) != [] and mined(spark, rows)


def test_bounds_hold_every_score():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    values = rng.integers(-200, 200, (500, 10))
    borders = np.sort(values[:100], axis=0)[np.arange(1, 64) * 100 // 64].T.copy()
    codes = np.stack([np.searchsorted(borders[j], values[:, j], "right") for j in range(10)], 1).astype(np.uint8)
    tile = hn.Tile(pa.table({"vec_id": np.arange(500), "label": np.zeros(500, int), "codes": [c.tobytes() for c in codes], "vector": [v.tobytes() for v in values]}), borders)
    anchors = rng.integers(-200, 200, (37, 10))
    lower, upper = tile.bounds(anchors)
    exact = values @ anchors.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < 0.2 * np.abs(exact).max()


def test_registered_query(spark, sf):
    r = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(x["vec_id"], (x["label"] + 1) % 10 if x["vec_id"] % 7 == 0 else x["label"], x["embedding"]) for x in r]
    assert sorted(tuple(x) for x in hn.op12_hard_negatives(spark, sf).collect()) == brute(rows, 50)
