"""Hard negatives by a vector-approximation file: bounds from quantised cells, exact scores for what may enter a window.

Each dimension is cut into 64 cells of about equally many values. The approximation file holds one byte a dimension;
for an anchor, the least and greatest product that a value of each cell can give are two small tables, and a row's
score lies between the sums of its cells' entries. Rows whose upper bound is under the lower bounds of enough others,
or whose bounds lie outside every window, are never scored; the rest are scored exactly, so the result is exact.

Anchors are a stated set of rows that meet all rows in tiles of bounded size (at most 65,536 rows by 16,384 anchors),
each a group of its own; a tile returns its best few for each anchor and window, and a window function takes the best
of all. Positives are looked for among rows of the anchor's label only.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows that
repeat an id count once, as the one of least label and then vector; a vector that is shorter than another counts as
followed by zeros; components beyond sqrt(2^62 / dimensions) (a million at 64) count as that, so that scores are exact
longs; ties go to the smaller id; anchors without positives or negatives give no rows; no rows give no rows.
Columns other than the three named ones aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

CELLS = 64
#: Rows that the cells' borders are taken from; bounds are right with any borders.
SAMPLE = 10_000
#: Rows and anchors of a tile at most, and what a numpy step takes of them.
ROWS, ANCHORS = 65_536, 16_384
ROW_STEP, ANCHOR_STEP = 1024, 32
#: Scores are multiples of 1 / SCALE^2.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95


def vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and vector (whole numbers, floor(256 x)) of the rows that take part, one for each id."""
    x = F.col("vector")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    rows = rows.withColumn("vector", F.transform(x, lambda v: F.floor(v * SCALE)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least")).select("vec_id", "least.label", "least.vector")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def approximation_file(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """vec_id, label, codes (a byte a dimension) and vector (64-bit whole numbers) of `vectors`, the cells' inner borders
    (dimensions, CELLS - 1), and the number of rows. Written to the shared folder."""
    rows = materialise(rows, "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 0
    limit = math.isqrt((1 << 62) // max(1, width))

    def filled(lists: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(lists), width), dtype=np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
        return np.clip(out, -limit, limit)

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    values = filled(pa.array(list(sample), pa.list_(pa.int64())))
    at = np.arange(1, CELLS) * len(values) // CELLS
    borders = np.sort(values, axis=0)[at].T.copy() if len(values) else np.zeros((width, CELLS - 1), dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = filled(batch.column(2))
            codes = np.empty(whole.shape, dtype=np.uint8)
            for j in range(width):
                codes[:, j] = np.searchsorted(borders[j], whole[:, j], "right")
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (codes, whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["vec_id", "label", "codes", "vector"])

    return materialise(rows.mapInArrow(work, "vec_id long, label long, codes binary, vector binary"), "approximations"), borders, n


class Tile:
    """The rows of a tile: ids in ascending order, labels, codes, vectors, and each cell's least and greatest value."""

    def __init__(self, table: pa.Table, borders: np.ndarray):
        table = table.sort_by("vec_id")
        width = len(borders)
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.vectors = _matrix(table.column("vector"), width)
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, width).T.copy()
        least, most = self.vectors.min(axis=0)[:, None], self.vectors.max(axis=0)[:, None]
        self.low, self.high = np.hstack([least, borders]), np.hstack([borders - 1, most])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows, anchors) of the rows' scores, by table lookup."""
        m, n = len(anchors), len(self.ids)
        most = float(np.abs(anchors).max(initial=0)) * max(float(np.abs(self.low).max(initial=0)), float(np.abs(self.high).max(initial=0)))
        kind = np.int32 if most * max(1, len(self.low)) < 2**31 else np.int64
        weight = anchors.T[:, None, :]
        x, y = weight * self.low[:, :, None], weight * self.high[:, :, None]
        tables = np.concatenate([np.minimum(x, y), np.maximum(x, y)], axis=2).astype(kind)
        out = np.zeros((n, 2 * m), dtype=kind)
        for first in range(0, n, ROW_STEP):
            part = out[first : first + ROW_STEP]
            for table, code in zip(tables, self.codes):
                part += table.take(code[first : first + ROW_STEP], axis=0)
        return out[:, :m], out[:, m:]

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return (self.vectors[at] * anchor).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score and then by id."""
    return np.lexsort((ids, -scores))[:k]


def _floor(lower: np.ndarray, k: int) -> int:
    """What an upper bound must reach to be among the k best of rows with these lower bounds."""
    return np.iinfo(np.int64).min if len(lower) < k else int(np.partition(lower, len(lower) - k)[len(lower) - k])


def _tiles(rows: DataFrame, anchors: DataFrame, n: int, m: int, keys: list[str], tile, schema: str) -> DataFrame:
    """tile(rows, anchors) of each tile: rows and anchors are dealt by id, and meet within equal keys."""
    blocks = max(1, -(-n // min(ROWS, max(2048, n // 64))))
    groups = max(1, -(-m // ANCHORS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    rows = rows.withColumn("block", deal(blocks)).withColumn("group", every(groups))
    anchors = anchors.toDF(*anchors.columns)  # columns of its own: both sides come from one table
    anchors = anchors.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    keys = [*keys, "block", "group"]
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(tile, schema)


def positives(rows: DataFrame, anchors: DataFrame, borders: np.ndarray, n: int, m: int, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, score: the k first other rows of each anchor's label."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            own = Tile(left, borders)
            ids, every = right.column("vec_id").to_numpy(), _matrix(right.column("vector"), len(borders))
            for first in range(0, len(ids), ANCHOR_STEP):
                lower, upper = own.bounds(every[first : first + ANCHOR_STEP])
                for i, (anchor, vector) in enumerate(zip(ids[first : first + ANCHOR_STEP], every[first : first + ANCHOR_STEP])):
                    other = own.ids != anchor
                    at = np.flatnonzero(other & (upper[:, i] >= _floor(lower[other, i], k)))
                    score = own.scores(at, vector)
                    out += [(anchor, own.ids[at[j]], score[j]) for j in _best(own.ids[at], score, k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], schema=schema)

    met = _tiles(rows, anchors, n, m, ["label"], tile, "anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return met.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").drop("rank")


def negatives(rows: DataFrame, anchors: DataFrame, borders: np.ndarray, n: int, m: int, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The k first rows of another label in each positive's window; anchors have `found`, arrays of (score, positive_id)."""
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            own = Tile(left, borders)
            ids, labels, every = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), _matrix(right.column("vector"), len(borders))
            found = right.column("found").to_pylist()
            for first in range(0, len(ids), ANCHOR_STEP):
                lower, upper = (x.astype(np.int64) for x in own.bounds(every[first : first + ANCHOR_STEP]))
                for i in range(lower.shape[1]):
                    anchor, other = first + i, np.flatnonzero(own.labels != labels[first + i])
                    lo, hi = lower[other, i], upper[other, i]
                    windows: dict[int, list[int]] = {}
                    for x in found[anchor]:
                        if x["score"] >= 0:  # else the window is empty
                            windows.setdefault(x["score"], []).append(x["positive_id"])
                    for score, of in windows.items():
                        least, most = -(-low * score // 100), high * score // 100  # of whole scores
                        sure = _floor(lo[(lo >= least) & (hi <= most)], k)
                        at = other[(hi >= max(least, sure)) & (lo <= most)]
                        exact = own.scores(at, every[anchor])
                        inside = (exact >= least) & (exact <= most)
                        at, exact = at[inside], exact[inside]
                        best = _best(own.ids[at], exact, k)
                        out += [(ids[anchor], p, own.ids[at[j]], score, exact[j]) for p in of for j in best]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], schema=schema)

    met = _tiles(rows, anchors, n, m, [], tile, ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def hard_negatives(rows: DataFrame, anchor: F.Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchor` says of `vec_id` which rows are anchors."""
    approximations, borders, n = approximation_file(vectors(rows, id_col, label_col, vector_col))
    anchors = approximations.where(anchor).drop("codes")
    m = anchors.count()
    pairs = positives(approximations, anchors, borders, n, m)
    found = materialise(pairs.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "positive_id")).alias("found")), "positives")
    anchors = anchors.join(found.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    out = negatives(approximations, anchors, borders, n, m)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 50 == 0)
