"""Helpers that the training-data operators share: materialised cuts of lineage and vectorised word hashing.

Words are hashed straight from Arrow buffers: a prefix sum of per-byte random values times powers of an odd
constant gives every word's 64-bit hash without a Python object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by numpy at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch.
BATCH_ROWS = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is set only where a local session has none, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sonoframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/sonoframe-{sc.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lost executors lose no work, plans stay short."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks, where the session's own number is smaller: tasks stay small as the input grows."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, with the rows of hot keys of left dealt over many tasks one by one.

    A key is hot if over 1,000 rows and over a thousandth of all have it, so at most 1,000 are; their rows of right are
    repeated once for each part. Rows without a key are dealt likewise. left is counted first and its rows are dealt by
    their place, so it should be a written table: equal rows and rows without an id are spread like any others.
    """
    most = max(1000, left.count() // 1000)
    hot = left.groupBy(*keys).agg(F.count("*").alias("_parts")).where(F.col("_parts") > most)
    hot = F.broadcast(hot.withColumn("_parts", F.ceil(F.col("_parts") / most)))  # 1,000 rows at most
    missing = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    parts = F.when(missing, 1000).otherwise(F.coalesce("_parts", F.lit(1)))
    left = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)).drop("_parts")
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession) -> None:
    """For where a query begins: Arrow batches of a session that has their default size get fewer rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # rows are whole texts or sets here, not numbers
        spark.conf.set(name, str(BATCH_ROWS))


def text_column(df: DataFrame, text: str = "text") -> DataFrame:
    """df with nulls in the text column taken as empty."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes of text (or one row): the run, its bytes, its n + 1 offsets."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    big = pa.types.is_large_string(col.type)
    if col.null_count:
        raise ValueError(f"{column}: nulls must be replaced first")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant and of its inverse, modulo 2^64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("p", _ODD), ("i", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each run values[start:end]: equal runs have equal hashes wherever they stand."""
    p, inv = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_RANDOM = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]


class Words:
    """The words of a run of texts: byte places, hashes, and each text's range of words.

    plain: words are runs of anything but white space (U+0020, U+0009 to U+000D); else of letters, digits and
    anything beyond ASCII. fold: A-Z count as a-z.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, plain: bool = True):
        word = ~(_SPACE if plain else _OTHER)[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the count of all
        self.hashes = runs((_FOLDED if fold else _RANDOM)[data], self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each k consecutive words of one text: the index of the first word, and the hash."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        room = np.repeat(self.first[1:], self.counts()) - np.arange(n)
        at = np.flatnonzero(room >= k)
        return at, runs(self.hashes, at, at + k)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
