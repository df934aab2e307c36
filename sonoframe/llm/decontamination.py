"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

An item counts as leaked if local alignment of words (match 2, mismatch and gap -1) reaches half of what its whole
text would score. Seeds lose no such document. A seed is a pair of words that stand one or two apart. An alignment of m
matches at cost c scores 2m - c, and between two matches in a row either both texts skip a word at most (then the pair
that begins at the first of the two is in both) or the cost is 2 at least. A score of s times 2L for L words so needs
k = sL - 1 of the item's L - 1 places with such a pair, and one of any L - k places is among them: each item is looked
for by the pairs of its L - k rarest places, however common its copies make these, whatever the corpus's size.

The corpus is read twice; only passages around seeds are shuffled. The first pass counts, over all documents, the pairs that a
fixed-size bit table of the benchmark's pairs lets through; the counts only say which places are the rarest. The second
pass lets the seeds' bit table choose passages around hits; a join of seed hashes then says which items each passage
may hold, passages with pairs of fewer than k places are left out, and alignment scores the others.

The bit tables have 2^22 bits whatever the benchmark's size; a fuller table lets more through, and the join decides.

Words are runs of letters, digits and anything beyond ASCII, A-Z as a-z. Defined results: null and empty texts, and
texts and items of fewer than three words, never match (nor any item at a score that one match reaches); a document that repeats is reported once per id and item.
Only the id and text columns of both tables are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, materialise, mix, read_table, signed, slices, spread_join, text_column

#: Words of the shortest text or item that matches.
LEAST = 3
#: How far apart the words of a pair stand.
APART = (1, 2)
BITS = 22
SCORE = 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each two words of one text that stand one or two apart: the index of the first word, in order, and the hash."""
    n = np.arange(len(hashes))
    end = np.repeat(first[1:], np.diff(first))
    at = [n[n + d < end] for d in APART]
    grams = [mix(hashes[i] * _ODD + hashes[i + d]) for i, d in zip(at, APART)]
    order = np.argsort(at := np.concatenate(at), kind="stable")
    return at[order], np.concatenate(grams)[order]


def _needed(n_words, score: float):
    """Of how many of an item's places pairs stand in any text that holds the item."""
    return np.maximum(np.ceil(n_words * score - 1e-9).astype(np.int64) - 1, 1)


def _reach(n_words: int, score: float) -> int:
    """The most words that an alignment of an item spans: its matches and as many gaps as the score allows."""
    return int(np.ceil(max(1.0, 3 - 2 * score) * n_words))


def _items(benchmark: DataFrame, id_col: str, text_col: str, score: float) -> DataFrame:
    """item_id, its word hashes, the places and hashes of its pairs, and how many places are needed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                words = Words(data, offsets, fold=True, plain=False)
                at, grams = _pairs(words.hashes, words.first)
                own = np.searchsorted(at, words.first)
                place = at - np.repeat(words.first[:-1], np.diff(own))
                lists = [pa.ListArray.from_arrays(pa.array(i.astype(np.int32)), v) for i, v in ((words.first, signed(words.hashes)), (own, pa.array(place)), (own, signed(grams)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(_needed(words.counts(), score))], ["item_id", "words", "places", "grams", "needed"])

    kind = dict(benchmark.dtypes)[id_col]
    return text_column(benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))).mapInArrow(work, f"item_id {kind}, words array<long>, places array<long>, grams array<long>, needed long")


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of 2^22 bits with those of column `gram` set: at most 65,536 rows reach the driver."""
    place = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for row in words.collect():
        table[row["word"]] = row["bits"]
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def _reach_table(seeds: DataFrame) -> np.ndarray:
    """For each of 2^22 slots, how many words around a seed (gram, reach) of that slot are read: the power of two that is
    at least the reach of every item with such a seed, plus one in the exponent; 0 without a seed. 2^19 rows at most reach the driver."""
    place = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))
    slots = seeds.groupBy(place.alias("slot")).agg((F.ceil(F.log2(F.max("reach"))) + 1).cast("long").alias("power"))
    words = slots.select(F.shiftright("slot", 3).alias("word"), F.expr("shiftleft(power, cast(slot & 7 as int) * 8)").alias("part")).groupBy("word").agg(F.bit_or("part").alias("parts"))
    table = np.zeros(1 << (BITS - 3), dtype=np.int64)
    found = words.toPandas()
    table[found["word"].to_numpy()] = found["parts"].to_numpy()
    return table.view(np.uint8)


def _through(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[(grams & np.uint64((1 << BITS) - 1)).astype(np.int64)])


def gram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """How often each of `grams` (gram) occurs in all of docs: (gram, n), without those that never do."""
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(_bit_table(grams)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table.value)
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                words = Words(data, offsets, fold=True, plain=False)
                _, found = _pairs(words.hashes, words.first)
                values, n = np.unique(found[_through(bits, found)], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(values), pa.array(n, pa.int64())], ["gram", "n"])

    counts = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return counts.join(grams.distinct(), "gram", "left_semi")


def _passages(docs: DataFrame, table) -> DataFrame:
    """Runs of words around seeds, each as far as its own items reach, those that overlap together: doc_id, first word, word hashes, seeds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                words = Words(data, offsets, fold=True, plain=False)
                at, grams = _pairs(words.hashes, words.first)
                hits = _through(table.value, grams)
                if not len(hits):
                    continue
                places, grams = at[hits], grams[hits]
                reach = np.int64(1) << (table.value[(grams & np.uint64((1 << BITS) - 1)).astype(np.int64)].astype(np.int64) - 1)
                doc = np.searchsorted(words.first, places, "right") - 1
                lo, hi = np.maximum(places - reach, words.first[doc]), np.minimum(places + max(APART) + 1 + reach, words.first[doc + 1])
                # texts are disjoint, so that what an earlier text's seeds reach never passes a later one's first word
                edge = np.flatnonzero((places[1:] > np.maximum.accumulate(hi)[:-1]) | (np.diff(doc) != 0)) + 1
                begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(hits)]])
                own = doc[begin]
                lo, hi = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(own)),
                        pa.array(lo - words.first[own]),
                        pa.array([words.hashes[a:b].view(np.int64) for a, b in zip(lo, hi)], pa.list_(pa.int64())),
                        pa.array([np.unique(grams[a:b]).view(np.int64) for a, b in zip(begin, end)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "first_word", "passage", "seeds"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, first_word long, passage array<long>, seeds array<long>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two word sequences, and the passage word it ends before."""
    row, steps = np.zeros(len(passage) + 1, dtype=np.int64), np.arange(len(passage) + 1)
    best, where = 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 2, -1))
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item: a running maximum that falls by 1 a word
        if (top := int(row.max())) > best:
            best, where = top, int(row.argmax())
    return best, where


def held(item: np.ndarray, passage: np.ndarray, score: float) -> tuple[int, int]:
    """align(), over the part of the passage that the item's pairs reach; 0 where too few of its places are in it for the score."""
    places, own = _pairs(item.view(np.uint64), np.array([0, len(item)]))
    at, grams = _pairs(passage.view(np.uint64), np.array([0, len(passage)]))
    if len(np.unique(places[np.isin(own, grams)])) < _needed(len(item), score):
        return 0, 0
    at, reach = at[np.isin(grams, own)], _reach(len(item), score)
    lo = max(int(at[0]) - reach, 0)
    best, end = align(item, passage[lo : at[-1] + max(APART) + 1 + reach])
    return best, lo + end


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, score (0 to 1) and the word the alignment ends before, for each document that holds an item."""
    spark = docs.sparkSession
    docs = text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    items = materialise(_items(benchmark, item_col, text_col, score).withColumn("item", F.monotonically_increasing_id()), "items").where(F.size("words") >= LEAST)
    grams = items.select("item", (F.size("words") - F.col("needed")).alias("few"), F.explode(F.arrays_zip("places", "grams")).alias("x")).select("item", "few", "x.places", F.col("x.grams").alias("gram")).distinct()
    counts = materialise(gram_counts(docs, grams.select("gram")), "counts")
    known = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    occur = known.groupBy("item", "places", "few").agg(F.sum("n").alias("occur"), F.collect_list(F.when(F.col("n") > 0, F.col("gram"))).alias("grams"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("occur", "places"))
    seeds = materialise(occur.withColumn("rank", rank).where("rank <= few").select("item", F.explode("grams").alias("gram")).distinct(), "seeds")
    reach = F.ceil(F.lit(max(1.0, 3 - 2 * score)) * F.size("words")).cast("long").alias("reach")
    table = spark.sparkContext.broadcast(_reach_table(seeds.join(items.select("item", reach), "item")))
    passages = materialise(_passages(docs, table).withColumn("place", F.monotonically_increasing_id()), "passages")
    pairs = materialise(passages.select("place", F.explode("seeds").alias("gram")).join(seeds, "gram").select("place", "item").distinct(), "pairs")
    pairs = spread_join(pairs, items.select("item", "item_id", "words"), ["item"])  # an item that many hold is dealt to many tasks
    pairs = pairs.join(passages.select("place", "doc_id", "first_word", "passage"), "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, ends = [], []
            for first, passage, item in zip(batch.column(2), batch.column(3), batch.column(4)):
                item, passage = item.values.to_numpy(), passage.values.to_numpy()
                best, end = held(item, passage, score)
                scores.append(best / (2 * len(item)))
                ends.append(first.as_py() + end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], ["doc_id", "item_id", "score", "end_word"])

    kind = dict(items.dtypes)["item_id"]
    scored = pairs.select("doc_id", "item_id", "first_word", "passage", "words").mapInArrow(work, f"doc_id long, item_id {kind}, score double, end_word long")
    best = scored.where(F.col("score") >= score).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", "x.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without an id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
