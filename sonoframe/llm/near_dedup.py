"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood, then verified on full sets.

A document's set is its distinct k-word shingles (A-Z as a-z; the whole sequence where there are fewer words).
Each of 96 registers keeps floor(1 - log_b(x)) for the least of exponential variates x over the set: exponentially
spaced truncated minima, which merge by maximum. Documents that share three registers of a band are candidates;
the joint maximum-likelihood estimate of their similarity drops pairs that are far below the threshold, and the
rest are verified on full shingle sets. A pair at 0.8 misses all 32 bands with probability 1e-10.

Equal sets are one class before any pair is formed. One count of shingles spares most classes any comparison: two
sets share at most what either has in common with all others, so copies of which a fifth is their own can't be linked.
In a band's bucket the other classes meet one pivot, if sizes allow a link. Verified links are contracted; in buckets
whose other classes are still several components, those meet chunk by chunk on full sets, in groups of buckets: no
link between components is lost, and no pair but links becomes a row.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; rows
without an id are kept and unlinked; rows that repeat an id are one document with the links of all its texts, and
share its fate. Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialise, read_table, runs, slices, spread_join, text_column
from .graph import components

REGISTERS, BAND = 96, 3
BASE, RATE = 1.001, 20.0
#: Sets of one chunk of a group: two chunks meet in a task.
CHUNK = 128
#: How far under the threshold an estimate may fall before its pair is dropped: 5 standard errors.
MARGIN = 0.205
_rng = np.random.default_rng(96)
_FLIP = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    counts = words.counts()
    _, windows = words.windows(k)
    ends = np.cumsum(np.maximum(counts - k + 1, 0))
    out = []
    for i, n in enumerate(counts):
        if n >= k:
            out.append(np.unique(windows[ends[i] - n + k - 1 : ends[i]]))
        else:
            out.append(runs(words.hashes[(a := words.first[i]) : a + n], np.array([0]), np.array([n])) if n else np.zeros(0, dtype=np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, (sets, REGISTERS) of uint16; none may be empty."""
    values = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((values ^ _FLIP[i]) * _TIMES[i], offsets)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 65535).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely similarity of each pair of register rows, given the sets' sizes: a grid search to 0.01."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * grid), p(v - u * grid)
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    log = lambda x: np.log(np.maximum(x, 1e-12))
    like = up * log(more) + down * log(less) + (REGISTERS - up - down) * log(1 - more - less)
    return np.take_along_axis(grid, like.argmax(1)[:, None], 1)[:, 0]


def sketch(docs: DataFrame, k: int, keep_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set) and sketch of each row of (doc_id, text); the set if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                sets = shingles(Words(data, offsets, fold=True), k)
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                columns = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([s.tobytes() for s in sets], pa.binary())] if keep_sets else []), names)

    names = ["doc_id", "n_shingles", "class", "sketch"] + (["hashes"] if keep_sets else [])
    return docs.mapInArrow(work, "doc_id long, n_shingles long, class binary, sketch binary" + (", hashes binary" if keep_sets else ""))


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that full sets link; sets are fetched only where the estimate isn't far below the threshold."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                get = lambda c: np.stack([np.frombuffer(x, "<u2") for x in batch.column(c).to_pylist()])
                size = lambda c: batch.column(c).to_numpy().astype(float)
                near = estimate(get(2), get(3), size(4), size(5)) >= percent / 100 - MARGIN
                yield batch.select(["a", "b"]).filter(pa.array(near))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def of(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        named = lambda side: table.toDF(side, *[f"{c}_{side}" for c in columns])
        return spread_join(pairs, named("a"), ["a"]).join(named("b"), "b")  # a pivot has many pairs, another class one a band

    some = of(pairs, classes.select("rep", "sketch", "n_shingles"), ["s", "n"])
    pairs = materialise(some.select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(likely, "a long, b long"), "likely")
    some = of(pairs, sets.select("doc_id", "hashes"), ["set"])
    return materialise(some.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long").distinct(), "links")


def _own(sets: DataFrame) -> DataFrame:
    """Of sets (doc_id, hashes): how many of a set's shingles no other set has, where there are any (doc_id, own)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                each = [np.frombuffer(x.as_py(), "<i8") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in each])), pa.array(np.concatenate(each))], ["doc_id", "hash"])

    once = sets.select("doc_id", "hashes").mapInArrow(work, "doc_id long, hash long").groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return once.where("n = 1").groupBy("doc_id").agg(F.count("*").alias("own"))


def _blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of one group, from rows (rep, component, group).

    A group is dealt into chunks of about CHUNK sets, and each two chunks meet in a task of their own, which counts
    all their common shingles by products of bounded matrices: only links leave it.
    """
    size = rows.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).alias("m"))
    rows = rows.join(size, "group").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("m")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    rows = rows.select("rep", "component", "i", "group", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    rows = rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def meet(table: pa.Table) -> pa.Table:
        rep, component, chunk = (table.column(c).to_numpy() for c in ("rep", "component", "i"))
        each = [np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes")]
        n = np.array([len(x) for x in each])
        values, column, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(each)), n)
        shared = count[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((len(each), len(each)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(column.max(initial=-1)) + 1, 4096):
            lo, hi = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(each), 4096), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - first] = 1
            both += part @ part.T
        near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        near &= component[:, None] != component[None, :]
        if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            near &= chunk[:, None] != chunk[None, :]
        a, b = np.nonzero(np.triu(near))
        return pa.table({"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])})

    return rows.groupBy("group", "lo", "hi").applyInArrow(meet, "a long, b long")


def _unjoined(members: DataFrame) -> DataFrame:
    """Members (key, rep, n, component) of buckets that hold two components or more."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return members.join(mixed, "key", "left_semi").select("key", "rep", "n", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class of every row; near duplicates share a component."""
    docs = text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows = materialise(sketch(docs, k), "sketches")
    first = F.min(F.struct("doc_id", "n_shingles", "sketch"))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(first.alias("x"))
    classes = materialise(classes.select("class", F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.sketch"), "classes")
    width = 2 * BAND
    keys = F.array(*[F.xxhash64(F.substring("sketch", 1 + width * i, width), F.lit(i)) for i in range(REGISTERS // BAND)])
    bands = classes.select("rep", F.col("n_shingles").alias("n"), F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = materialise(bands.join(shared, "key", "left_semi"), "members")
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    # what is needed grows with the corpus: never broadcast, so that the plan is the same at every size
    sets = sketch(docs.join(needed.hint("merge"), "doc_id").select("doc_id", "text"), k, keep_sets=True).select("doc_id", "hashes")
    sets = materialise(sets, "sets")  # the only shuffle of texts
    # a link needs so many common shingles: what has fewer in common with all others together is linked with nothing
    alone = _own(sets).join(classes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id").where(f"100 * (n_shingles - own) < {percent} * n_shingles")
    left = members.join(alone.select(F.col("doc_id").alias("rep")), "rep", "left_anti").withColumn("component", F.col("rep"))
    left = materialise(_unjoined(left), "left")
    pivots = left.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("pivot"))
    met = left.join(pivots, "key").where("rep <> pivot.rep")
    star = met.where(f"100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)").select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b"))
    links = _links(materialise(star.distinct(), "star"), classes, sets, percent)
    joined = components(links)
    left = met.select("key", "rep", "n").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    left = materialise(_unjoined(left), "left")
    least = left.groupBy("key").agg(F.min("rep").alias("a"))
    groups = components(left.join(least, "key").select("a", F.col("rep").alias("b")))
    left = left.groupBy("rep").agg(F.first("component").alias("component")).join(groups.select(F.col("node").alias("rep"), F.col("component").alias("group")), "rep")
    rest = materialise(_blocks(left, sets, percent), "rest")
    if rest.limit(1).count():
        joined = components(links.union(rest))
    label = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    out = spread_join(rows, label, ["class"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.hex("class").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id."""
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4).drop("class_id")
