"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. Each has a logistic model over hashed words and word beginnings (inflected forms
share them), weighted by their log-count ratios, and over the earlier categories' log-odds; those are out-of-fold predictions when the model is fitted, so that a
later model never learns from an earlier one's fit to the same rows. Models are fitted with numpy on at most SAMPLE
labelled rows (and SAMPLE_BINS bins: 16 MB reach the driver), the first by a hash of their id; every document is
scored in whole.

Defined results: null and empty texts have no words and get the models' base rates; labels with null categories or
ids are not learned from; a category without two labelled rows of each kind is never predicted; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, materialise, mix, read_table, slices, text_column

BITS = 18
BEGINNINGS = (4, 5, 6)
SAMPLE = 5000
#: Distinct bins that those rows may have together; the first rows by hash that keep within it are taken.
SAMPLE_BINS = 4_000_000
FOLDS = 3
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct bins of words and of word beginnings of BEGINNINGS bytes, concatenated, and their ranges."""
    words = Words(data, offsets, fold=True, plain=False)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), words.counts())
    size = words.ends - words.starts
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    docs, hashes = [doc], [words.hashes]
    for n in BEGINNINGS:
        own = np.flatnonzero(size > n)
        h = np.full(len(own), n, dtype=np.uint64)
        for i in range(n):
            h = (h + low[words.starts[own] + i]) * _TIMES
        docs.append(doc[own])
        hashes.append(mix(h))
    bins = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique((np.concatenate(docs) << BITS) | bins)
    return pairs & ((1 << BITS) - 1), np.searchsorted(pairs >> BITS, np.arange(len(offsets)))


class Linear:
    """Logistic regression on sets of bins and dense extras, by averaged gradient steps with a ridge."""

    def __init__(self, bins: np.ndarray, first: np.ndarray, extra: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3):
        n = np.diff(first)
        row = np.repeat(np.arange(len(y), dtype=np.int32), n)
        count = lambda w: np.bincount(bins, weights=w[row], minlength=1 << BITS)
        pos, neg = count(y), count(1 - y)
        ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
        self.ratio = np.where(pos + neg >= 3, ratio, 0.0)  # words of one or two labelled rows say nothing
        keep = self.ratio[bins] != 0
        bins, row = bins[keep], row[keep]
        x = self.ratio[bins]
        self.w, self.extra = np.zeros(1 << BITS), np.zeros(extra.shape[1])
        self.bias = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
        scale = 1 / (np.bincount(row, weights=x * x, minlength=len(y)).max(initial=0) + (extra**2).sum(1).max(initial=0) + 1)
        momentum = [np.zeros(1 << BITS), np.zeros(extra.shape[1]), 0.0]
        rate = 4 * scale * 20
        for _ in range(rounds):
            z = np.bincount(row, weights=self.w[bins] * x, minlength=len(y)) + extra @ self.extra + self.bias
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))) / len(y)
            grads = [np.bincount(bins, weights=off[row] * x, minlength=1 << BITS) + ridge * self.w, extra.T @ off, off.sum()]
            momentum = [0.9 * m + g for m, g in zip(momentum, grads)]
            self.w -= rate * momentum[0]
            self.extra -= rate * momentum[1]
            self.bias -= rate * momentum[2]
        self.w *= self.ratio

    def odds(self, bins: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.w[bins])])
        return total[first[1:]] - total[first[:-1]] + extra @ self.extra + self.bias


def _rows(bins: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    return bins[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])


def fit_chain(bins: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[list[Linear], list[float]]:
    """A model for each column of labels, and for each the threshold on log-odds whose F-0.5 is best out of fold."""
    n = len(labels)
    common = np.bincount(bins, minlength=1 << BITS)[bins] >= 3  # no model learns from rarer ones
    first = np.concatenate([[0], np.cumsum(common)])[first]
    bins = bins[common]
    fold = np.arange(n) % FOLDS
    extra, models, thresholds = np.zeros((n, 0)), [], []
    for y in labels.T.astype(float):
        if min(y.sum(), (1 - y).sum()) < 2:
            models.append(None)
            thresholds.append(np.inf)
            extra = np.hstack([extra, np.zeros((n, 1))])
            continue
        out = np.zeros(n)
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            model = Linear(*_rows(bins, first, train), extra[train], y[train])
            out[test] = model.odds(*_rows(bins, first, test), extra[test])
        order = np.argsort(-out)
        hit = np.cumsum(y[order])
        f = 1.25 * hit / (np.arange(1, n + 1) + 0.25 * y.sum())  # precision counts twice as much as recall
        best = int(f.argmax())
        nxt = out[order[best + 1]] if best + 1 < n else out[order[best]] - 1
        thresholds.append(float((out[order[best]] + nxt) / 2))
        models.append(Linear(bins, first, extra, y))
        extra = np.hstack([extra, np.clip(out, -8, 8)[:, None]])
    return models, thresholds


def score(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> DataFrame:
    """doc_id, and for each category p_<category> and <category> (boolean), of every row of documents."""
    spark = docs.sparkSession
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                bins, first = _features(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bins.astype(np.int32))), *part.columns[2:]], ["doc_id", "bins", *categories])

    rows = docs.join(F.broadcast(few), "doc_id").select("doc_id", "text", *categories)  # few: SAMPLE small rows at most
    rows = rows.mapInArrow(gather, "doc_id long, bins array<int>, " + ", ".join(f"{c} int" for c in categories))
    rows = materialise(rows.groupBy("doc_id").agg(F.min("bins").alias("bins"), *[F.min(c).alias(c) for c in categories]), "labelled")
    # a running total over SAMPLE numbers says which rows keep within the bound
    total = F.sum(F.size("bins")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = rows.select("doc_id", total.alias("total")).where(F.col("total") <= SAMPLE_BINS).select("doc_id")
    rows = rows.join(F.broadcast(within), "doc_id").toPandas().sort_values("doc_id")
    lists = list(rows.bins)
    bins = np.concatenate([*lists, np.zeros(0, dtype=np.int32)]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    models, thresholds = fit_chain(bins, first, rows[categories].to_numpy())
    packed = spark.sparkContext.broadcast([None if m is None else (m.w.astype(np.float32), m.extra, m.bias) for m in models])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                bins, first = _features(data, offsets)
                extra, columns = np.zeros((part.num_rows, 0)), [part.column(0)]
                for model, threshold in zip(packed.value, thresholds):
                    odds = np.full(part.num_rows, -30.0)
                    if model is not None:
                        total = np.concatenate([[0.0], np.cumsum(model[0][bins], dtype=np.float64)])
                        odds = total[first[1:]] - total[first[:-1]] + extra @ model[1] + model[2]
                    columns += [pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30)))), pa.array(odds >= threshold)]
                    extra = np.hstack([extra, np.clip(odds, -8, 8)[:, None] if model is not None else np.zeros((part.num_rows, 1))])
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *[x for c in categories for x in (f"p_{c}", c)]]
    return docs.mapInArrow(work, "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in categories))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return score(read_table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"]).select("doc_id", "toxic", "p_toxic", "p_low_quality")
