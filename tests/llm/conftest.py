import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, class string, hashes string, spans string, found string, text_hash string, batch string"


def frame(spark, rows):
    """documents of (doc_id, text) or (doc_id, text, lang, source), with more columns under names that operators use inside."""
    full = [(i, t, *(rest or ("en", "h")), len(t or ""), *["x"] * 7) for i, t, *rest in rows]
    return spark.createDataFrame(full, COLUMNS)


def prose(seed, n, words=("the", "of", "and", "tion", "ing", "heron", "dawn", "reed", "wind", "marsh", "field", "night")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(("", "a", "er", "ish", "on", "el", "ly")) + rng.choice(("", "", "th", "ne", "ro")) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows and a row without an id."""
    long_ = prose(1, 30000)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, long_), (7, "x" * 100_000), (8, "the same words again and again"), (8, "the same words again and again"),
        (None, "a text without an id, of a few words"), (9, prose(2, 200), None, None), (10, "ZürichÉ 日本語 😀 ends"), (-5, prose(2, 200)), (2**62, prose(3, 60)),
    ]
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
