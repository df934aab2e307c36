"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0 .. n-1 in the order of a digest of their id and text, whatever files or partitions they came in.
A keyed Feistel network permutes the numbers of the least power of two that holds n; a number that falls outside n
walks on along its cycle until it is inside, so what is left is a permutation of 0 .. n-1. Place p is slot
p // shards of shard p % shards: counts differ by one at most, slots have no gaps, and both directions are computed
from n, the seed and the number of shards alone: a reader finds the row of any shard and slot without a table.

Numbering is a prefix sum: equal rows are counted first (so a hot row is one row), each of 2^14 ranges of digests is
ordered by itself, and the ranges' sums are added up. Only ids, sizes and digests are shuffled, never texts.

Defined results: a null text counts as an empty one, of size 1; rows without an id are numbered by their text's
digest; rows that repeat an id, or are equal, are rows of their own with places of their own; no rows give no rows.
Equal texts (the groups) aren't kept together: under the law of rows a group of any size is spread over all shards.
Other columns of the input are not read by `places`; `write_shards` writes them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

SHARDS = 16
#: Hexadecimal digits of a digest that name its range, half of the last one only: 2^14 ranges.
RANGES = 1 << 14
#: Copies of one row that one task makes.
COPIES = 10_000
ROUNDS = 6
# fixed odd factors of a 32-bit mixing function
_A, _B = 0x9E3779B1, 0x85EBCA77
_M = 0xFFFFFFFF


class Permutation:
    """A keyed permutation of 0 .. n-1 (n up to 2^62) that can be computed in both directions."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        bits = max(2, (n - 1).bit_length())
        self.low, self.high = bits // 2, bits - bits // 2
        digest = hashlib.sha256(f"feistel:{seed}".encode()).digest()
        self.keys = [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(ROUNDS)]

    @staticmethod
    def _mixed(x: np.ndarray, key: int) -> np.ndarray:
        m = np.uint64(_M)
        x = ((x ^ np.uint64(key)) * np.uint64(_A)) & m
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(_B)) & m
        return x ^ (x >> np.uint64(13))

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        """One pass of the network over 2^bits numbers. Halves swap their widths each round; rounds are even in number."""
        widths = [(self.high, self.low), (self.low, self.high)]
        left, right = x >> np.uint64(self.low), x & np.uint64((1 << self.low) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            mask = np.uint64((1 << widths[i % 2][0]) - 1)
            if back:
                left, right = right ^ (self._mixed(left, self.keys[i]) & mask), left
            else:
                left, right = right, left ^ (self._mixed(right, self.keys[i]) & mask)
        return left << np.uint64(self.low) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._network(x.astype(np.uint64), back)
        while (outside := np.flatnonzero(x >= self.n)).size:
            x[outside] = self._network(x[outside], back)
        return x.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


def numbered(keys: DataFrame, digest: str) -> tuple[DataFrame, int]:
    """Counted keys (digest, n, ...) with `before`, the rows of smaller digests, and the number of all rows.

    keys: a written table with one row for each digest (32 hexadecimal digits).
    """
    part = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long").bitwiseAND((RANGES - 1) << 2)
    keys = keys.withColumn("_range", part)
    sums = keys.groupBy("_range").agg(F.sum("n").alias("_n"))  # 2^14 rows at most
    total = sums.agg(F.sum("_n")).first()[0] or 0
    sums = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))
    within = F.sum("n").over(Window.partitionBy("_range").orderBy(digest)) - F.col("n")
    out = keys.withColumn("_within", within).join(F.broadcast(sums), "_range")
    return out.withColumn("before", F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset"), total


def copied(keys: DataFrame) -> DataFrame:
    """Each row n times, with `row`: before, before + 1, ...; many copies of one row are made by many tasks."""
    few = keys.where(f"n <= {COPIES}").withColumn("row", F.explode(F.sequence(F.col("before"), F.expr("before + n - 1"))))
    many = keys.where(f"n > {COPIES}").withColumn("_first", F.explode(F.expr(f"sequence(before, before + n - 1, {COPIES}L)")))
    many = many.repartition("_first").withColumn("row", F.explode(F.expr(f"sequence(_first, least(_first + {COPIES - 1}, before + n - 1))")))
    return few.unionByName(many.drop("_first")).drop("before", "n")


def placed(rows: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """rows with `shard` and `slot` in the place of their `row`."""
    permutation = Permutation(total, seed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permutation.place(batch.column(at).to_numpy())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names)

    at = rows.columns.index("row")
    fields = [f for f in rows.schema if f.name != "row"]
    names = [*[f.name for f in fields], "shard", "slot"]
    schema = rows.select(*[F.col(f"`{f.name}`") for f in fields], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    return rows.mapInArrow(work, schema)


def _digest(id_col: str, text: F.Column, *more: F.Column) -> F.Column:
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary")), *more]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def places(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes of the text, plus 1), text_crc32, shard and slot of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _digest(id_col, text).alias("digest"))
    counted = materialise(rows.groupBy("digest", id_col, "size", "text_crc32").agg(F.count("*").alias("n")), "counted")
    keys, total = numbered(counted, "digest")
    return placed(copied(keys).drop("digest"), total, shards, seed)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet under `folder`/shard=N, each file in order of `slot`.

    Rows are numbered by a digest of all columns, so that only wholly equal rows are interchangeable. Columns of docs
    that are named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [F.xxhash64(F.to_json(F.struct(F.col(f"`{f.name}`").alias("x")))).cast("string") for f in docs.schema if f.name not in (id_col, text_col)]
    null = F.col(text_col).isNull().cast("string")
    keyed = docs.withColumn("_digest", F.concat(_digest(id_col, text), F.md5(F.concat_ws(":", null, *others).cast("binary"))))
    counted = materialise(keyed.groupBy("_digest").agg(F.count("*").alias("n")), "counted")
    keys, total = numbered(counted, "_digest")
    whole = keyed.dropDuplicates(["_digest"]).join(keys, "_digest")
    out = placed(copied(whole).drop("_digest"), total, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is `rows`: counts of the shards are at most one apart."""
    out = places(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_sql(seed: int = 0, shards: int = SHARDS) -> str:
    """The same rows by DuckDB: numbers by one ordering, walks by recursion, checksums by a fold over bytes."""
    keys = Permutation(2, seed).keys

    def mixed(x: str, key: int) -> str:
        x = f"((xor({x}, {key}::ubigint)::hugeint * {_A}) & {_M})::ubigint"
        x = f"((xor({x}, {x} >> 15)::hugeint * {_B}) & {_M})::ubigint"
        return f"xor({x}, {x} >> 13)"

    step = "select k, x, (x >> lo)::ubigint l, (x & ((1::ubigint << lo) - 1))::ubigint r, lo, hi, n from ({})"
    for i, key in enumerate(keys):
        step = f"select k, r as l, xor(l, {mixed('r', key)} & ((1::ubigint << {('hi', 'lo')[i % 2]}) - 1)) r, lo, hi, n from ({step})"
    step = f"select k, ((l << lo) | r)::ubigint x, lo, hi, n from ({step})"
    return f"""with recursive t as (select doc_id, coalesce(text, '') text from documents),
 d as (select doc_id, text, (row_number() over (order by md5(coalesce(doc_id::varchar, '') || ':' || md5(text))) - 1)::ubigint k, count(*) over () n from t),
 z as (select k, k x, n::ubigint n, greatest(2, length(ltrim(bin((n - 1)::ubigint), '0'))) b from d),
 w as ({step.format("select k, x, n, (b // 2)::ubigint lo, (b - b // 2)::ubigint hi from z")} union all {step.format("select k, x, n, lo, hi from w where x >= n")}),
 p as (select k, x::bigint place from w where x < n),
 crc as (select list(c order by i) tab from (select i, list_reduce(range(8), lambda a, _: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end, i::bigint) c from range(256) r(i))),
 chars as (select k, string_split(text, '') cs from d),
 bytes as (select k, flatten(list_transform(cs, lambda c: case when c = '' then []::integer[] when ord(c) < 128 then [ord(c)] when ord(c) < 2048 then [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]
   when ord(c) < 65536 then [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] else [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] end)) bs from chars),
 sums as (select k, xor(4294967295, list_reduce(bs, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::bigint)) crc from bytes, crc)
 select doc_id, strlen(text)::bigint + 1 as size, crc::bigint text_crc32, 'rows' law, (place % {shards})::integer shard, place // {shards} slot, null::integer grown_shard
 from d join p using (k) join sums using (k)"""
