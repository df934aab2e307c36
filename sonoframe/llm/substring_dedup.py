"""Removal of repeated passages by level-wise doubling.

A window is 35 consecutive words. The ladder of lengths is 9, 18, 35: a window can only be repeated if the shorter
windows inside it are. At each level every surviving 35-word window names one window of the level's length inside
it, the one of least hash (leftmost of ties), so equal windows name equal ones; those are counted over the whole
corpus, and a window whose named one stands alone is dropped. The survivors are extended to the next length, and at
the last one they are counted themselves. A count of one also says where that one is, so each level needs one
shuffle of hashes and one of the positions that stand alone.

Documents with the same words are one class before the ladder begins: with 35 words or more, all of a class of two
or more goes. Texts are shuffled once in full, then only those that still have candidates.

Defined results: null and empty texts have no words; fewer than 35 words: nothing is removed; repeated rows count as
places of their own; rows may lack an id. Windows are told apart by 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialise, read_table, slices, spread_join, text_column

LEVELS = (9, 18, 35)
_NONE = np.uint64(2**64 - 1)


class Windows:
    """The long windows of a run of texts: `at`, their first words, and for each level the word where the named window starts."""

    def __init__(self, words: Words, levels: tuple[int, ...]):
        self.words, self.levels = words, levels
        self.at, self.hashes = words.windows(levels[-1])

    def named(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Each long window's named window of a level's length (the first word's index), and all such windows' hashes by first word."""
        n = len(self.words.hashes)
        value = np.full(n, _NONE)
        at, hashes = self.words.windows(self.levels[level])
        value[at] = hashes
        span, width = self.levels[-1] - self.levels[level] + 1, 1
        best, where = value.copy(), np.arange(n)

        def wider(by: int) -> None:
            later = best[by:] < best[:-by]
            where[:-by] = np.where(later, where[by:], where[:-by])
            best[:-by] = np.where(later, best[by:], best[:-by])

        while 2 * width <= span and width < n:
            wider(width)
            width *= 2
        if 0 < span - width < n:
            wider(span - width)
        return where[self.at], value

    def alone(self, starts: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        """Which of `starts` (sorted) stand alone: lists has, for each text, places in the text's own part of starts."""
        out = np.zeros(len(starts), dtype=bool)
        begin = np.searchsorted(starts, self.words.first)
        for i, own in enumerate(lists):
            if len(own):
                out[begin[i] + own] = True
        return out

    def split(self, starts: np.ndarray, values: np.ndarray) -> pa.Array:
        """One list of values for each text; starts: the values' words, sorted."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, self.words.first).astype(np.int32)), pa.array(values.view(np.int64)))


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, dtype=np.int64) if x else np.zeros(0, dtype=np.int64) for x in column.to_pylist()]


def _survey(docs: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Each row's word count, digest of its words, and the hashes of its named windows at the first level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                windows = Windows(words := Words(data, offsets), levels)
                where, value = windows.named(0)
                starts = np.unique(where)
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words.counts(), pa.int64()), pa.array(digests), windows.split(starts, value[starts])], names)

    names = ["doc_id", "text_hash", "n_words", "sha256", "named"]
    return docs.select("doc_id", "text_hash", "text").mapInArrow(work, "doc_id long, text_hash long, n_words long, sha256 string, named array<long>")


def _alone(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Of (key, array of hashes): per key, the places whose hash occurs once in all arrays. Partial counts come before the shuffle."""
    each = rows.select("key", F.posexplode(column).alias("i", "h"))
    once = each.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("i").alias("i")).where("n = 1")
    return once.groupBy("key").agg(F.collect_list("i").alias(name))


def _survivors(windows: Windows, first: pa.Array, second: pa.Array | None) -> tuple[np.ndarray, ...]:
    """Which long windows survive the first level (and the second), and the second level's named windows of the first's survivors."""
    where, _ = windows.named(0)
    starts, place = np.unique(where, return_inverse=True)
    live = ~windows.alone(starts, _lists(first))[place] if len(where) else np.zeros(0, dtype=bool)
    where, value = windows.named(1)
    starts, place = np.unique(where[live], return_inverse=True)
    if second is not None and len(starts):
        live[np.flatnonzero(live)[windows.alone(starts, _lists(second))[place]]] = False
    return live, starts, value


def repeated_passages(docs: DataFrame, levels: tuple[int, ...] = LEVELS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Of every row: doc_id, n_words, n_removed, kept_sha256, and kept_text (what is left, joined by one space) if asked for."""
    if any(b > 2 * a for a, b in zip(levels, levels[1:])) or len(levels) != 3:
        raise ValueError("three lengths, each at most twice the one before")
    width = levels[-1]
    docs = text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).withColumn("text_hash", F.xxhash64("text"))
    rows = materialise(_survey(docs, levels), "survey")
    first = F.min(F.struct("doc_id", "text_hash", "named")).alias("x")
    classes = rows.where(F.col("n_words") >= width).groupBy("sha256").agg(first, F.count("*").alias("copies"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("key"), "sha256", "copies", "x.*"), "classes")
    lone = _alone(classes, "named", "lone")
    held = classes.join(lone, "key", "left").where("size(named) > coalesce(size(lone), 0)").select("key", "copies", "doc_id", "text_hash", "lone")
    same = (F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))) & (F.col("d.text_hash") == F.col("h.text_hash"))
    texts = docs.alias("d").join(materialise(held, "held").alias("h"), same).select("h.key", "h.copies", "h.lone", "d.text")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                windows = Windows(Words(data, offsets), levels)
                _, starts, value = _survivors(windows, part.column(2), None)
                yield pa.RecordBatch.from_arrays([*part.columns, windows.split(starts, value[starts])], ["key", "copies", "lone", "text", "named"])

    schema = "key long, copies long, lone array<int>, text string, named array<long>"
    texts = materialise(texts.mapInArrow(second, schema), "texts").where("size(named) > 0")
    # rows that repeat an id and its text would count twice
    lone = _alone(texts.select("key", "named").dropDuplicates(["key"]), "named", "lone2")

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                windows = Windows(Words(data, offsets), levels)
                live, _, _ = _survivors(windows, part.column(2), part.column(4))
                at, hashes = windows.at[live], windows.hashes[live]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), windows.split(at, at - np.repeat(windows.words.first[:-1], np.diff(np.searchsorted(at, windows.words.first)))), windows.split(at, hashes)], ["key", "text", "starts", "hashes"])

    left = texts.join(lone, "key", "left").where("size(named) > coalesce(size(lone2), 0)").dropDuplicates(["key"]).select("key", "copies", "lone", "text", "lone2")
    left = materialise(left.mapInArrow(third, "key long, text string, starts array<long>, hashes array<long>"), "windows").where("size(starts) > 0")
    lone = _alone(left, "hashes", "lone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for text, starts, own in zip(batch.column(1), _lists(batch.column(2)), _lists(batch.column(3))):
                starts = np.delete(starts, own)
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                n.append(len(words) - len(keep))
                kept.append(b" ".join(words[i] for i in keep).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "kept_text"])

    done = left.join(lone, "key", "left").select("key", "text", "starts", "lone").mapInArrow(cut, "key long, n_removed long, kept_text string")
    done = done.select("key", F.col("n_removed").alias("cut"), F.sha2("kept_text", 256).alias("cut_sha256"), *(["kept_text"] if keep_text else []))
    fate = classes.select("key", "sha256", "copies").join(done, "key", "left").where("copies > 1 or cut > 0").drop("key")
    out = spread_join(rows.drop("named", "text_hash"), fate, ["sha256"], "left")  # a text of many copies is dealt to many tasks
    all_ = F.col("copies") > 1
    columns = [F.when(all_, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"), F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256")]
    return out.select("doc_id", "n_words", *columns, *([F.when(all_, "").otherwise(F.col("kept_text")).alias("kept_text")] if keep_text else []))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"), keep_text=False)
