"""What a lossless coder works out for each block of samples: the cheapest Rice partitions, and linear predictors.

Blocks' sums come from grouping, so blocks of any recording are worked on anywhere; what is left of a block (256
partitions of 33 sums, or a few sums of products) is a row, and rows are worked on in vectors.

Defined results: null residuals or samples are left out before blocks are counted; blocks without residuals give no rows;
silence has no predictors. Residuals are whole numbers of 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Halvings of a block, and the largest parameter.
ORDERS, MOST = 8, 30
RICE = "order int, bits long, parameters array<int>, raw int, wide boolean"


def deepest(n: int, warmup: int) -> int:
    """How often a block of n samples can be halved: evenly, and with more than the warm-up in its first part."""
    order = 0
    while order < ORDERS and n % (2 << order) == 0 and n >> (order + 1) > warmup:
        order += 1
    return order


def pyramid(lengths: np.ndarray, sums: np.ndarray, shifted: np.ndarray, widest: np.ndarray) -> tuple[int, int, list[int | None], int, bool]:
    """The cheapest order of a block, from its finest partitions: their lengths, sums of residuals, sums of residuals
    shifted by each parameter (partitions, MOST + 1) and the bits of their widest. Coarser partitions are merged pairs.

    Returns the order, bits, a parameter for each partition (None: written raw), the bits of raw ones, and whether
    parameters take five bits.
    """
    best = None
    order = len(lengths).bit_length() - 1
    k = np.arange(MOST + 1)
    found = []
    while True:
        mean = np.divide(sums, lengths, out=np.zeros(len(sums)), where=lengths > 0).astype(np.int64)
        guess = np.array([max(int(m).bit_length() - 1, 0) for m in mean])
        costs = lengths[:, None] * (k + 1) + shifted
        near = np.abs(k - guess[:, None]) <= 1
        parameter = np.where(near, costs, np.iinfo(np.int64).max).argmin(1)
        bits = costs[np.arange(len(costs)), parameter]
        plain = lengths * widest + 5
        raw = (lengths > 0) & (plain < bits)
        wide = bool((parameter[~raw] > 14).any())
        total = int(np.where(raw, plain, bits).sum()) + len(lengths) * (5 if wide else 4) + 6
        found.append((order, total, [None if r else int(p) for p, r in zip(parameter, raw)], int(widest[raw].max(initial=0)), wide))
        if not order:
            break
        lengths, sums, shifted = (x.reshape(-1, 2, *x.shape[1:]).sum(1) for x in (lengths, sums, shifted))
        widest = widest.reshape(-1, 2).max(1)
        order -= 1
    for x in reversed(found):  # the coarsest of equals
        if best is None or x[1] < best[1]:
            best = x
    return best


def rice_partitions(residuals: DataFrame, keys: list[str], warmup: int = 0, at: str = "at", value: str = "value") -> DataFrame:
    """keys, order, bits, parameters, raw and wide of each block of residuals: `at` counts samples from 0, the first
    `warmup` of which have no residual."""
    rows = residuals.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(at).cast("long").alias("at"), F.col(value).cast("long").alias("v"))
    rows = rows.withColumn("u", F.when(F.col("v") < 0, -2 * F.col("v") - 1).otherwise(2 * F.col("v")))
    size = rows.groupBy(*keys).agg((F.max("at") + 1).alias("n"))
    deep = F.lit(0)
    for order in range(1, ORDERS + 1):
        deep = F.when((deep == order - 1) & (F.col("n") % (1 << order) == 0) & (F.shiftright("n", order) > warmup), order).otherwise(deep)
    size = size.withColumn("deep", deep)
    rows = rows.join(size, keys).withColumn("part", F.expr("at div (n div shiftleft(1L, deep))"))
    bits = lambda x: F.when(x == 0, 0).otherwise(F.length(F.bin(x)))
    sums = [F.sum(F.shiftright("u", k)).alias(f"s{k}") for k in range(MOST + 1)]
    parts = rows.groupBy(*keys, "n", "deep", "part").agg(F.count("*").alias("len"), F.max(1 + bits(F.shiftright("u", 1))).alias("widest"), *sums)
    gathered = parts.groupBy(*keys, "n", "deep").agg(F.collect_list(F.struct("part", "len", "widest", *[f"s{k}" for k in range(MOST + 1)])).alias("parts"))  # 256 at most

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for deep, parts in zip(pdf["deep"], pdf["parts"]):
                table = np.zeros((1 << int(deep), MOST + 3), dtype=np.int64)
                for p in parts:
                    row = list(p.values() if isinstance(p, dict) else p)
                    table[row[0]] = row[1:]
                made.append(pyramid(table[:, 0], table[:, 2], table[:, 2:], table[:, 1]))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(made, columns=["order", "bits", "parameters", "raw", "wide"])], axis=1)

    kinds = dict(gathered.dtypes)
    return gathered.mapInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + RICE)


def precision(bits: int, n: int) -> int:
    """The bits of a quantised coefficient, by the depth of samples and the length of a block."""
    if bits < 16:
        return max(2 + bits // 2, 5)
    # fixed values: the lengths up to which fewer bits do
    steps = (192, 384, 576, 1152, 2304, 4608) if bits == 16 else (384, 1152)
    return (7 if bits == 16 else 13) + sum(n > x for x in steps)


def durbin(auto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of autocorrelations (rows, most + 1): the coefficients of every order (rows, most, most), and what error
    each leaves (rows, most). A row ends where its error does: later orders are NaN."""
    rows, most = len(auto), auto.shape[1] - 1
    out, errors = np.full((rows, most, most), np.nan), np.full((rows, most), np.nan)
    error, a = auto[:, 0].copy(), np.zeros((rows, 0))
    live = error > 0
    for i in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (auto[:, i + 1] - (a * auto[:, i:0:-1]).sum(1)) / error
        a = np.hstack([a - r[:, None] * a[:, ::-1], r[:, None]])
        error = error * (1 - r * r)
        out[live, i, : i + 1], errors[live, i] = a[live], error[live]
        live = live & (error > 0)
    return out, errors


def quantised(coefficients: np.ndarray, precision: int) -> tuple[list[int], int] | None:
    """Whole coefficients and the shift that scales them back; each passes its rounding on. None if no shift fits."""
    most = float(np.abs(coefficients).max(initial=0))
    if not 0 < most < float("inf"):
        return None
    shift = min(precision - 1 - (int(np.floor(np.log2(most))) + 1), 15)
    if shift < 0:
        return None
    limit, carry, out = (1 << (precision - 1)) - 1, 0.0, []
    for x in coefficients:
        carry += float(x) * (1 << shift)
        q = int(np.clip(np.trunc(carry + np.copysign(0.5, carry)), -limit - 1, limit))
        carry -= q
        out.append(q)
    return out, shift


def autocorrelation(samples: DataFrame, keys: list[str], most: int, at: str = "at", value: str = "value") -> DataFrame:
    """keys, n and auto (array of most + 1 sums) of each block of samples under a Tukey window that tapers a quarter on either side."""
    rows = samples.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = rows.select(*keys, F.col(at).alias("at"), F.col(value).cast("double").alias("v"), n.alias("n"), (F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1).alias("i"))
    taper = F.greatest(F.expr("n div 4"), F.lit(1))
    edge = lambda x: 0.5 - 0.5 * F.cos(F.lit(np.pi) * x / taper)
    window = F.when(F.col("i") < taper, edge(F.col("i"))).when(F.col("i") >= F.col("n") - taper, edge(F.col("n") - 1 - F.col("i"))).otherwise(1.0)
    rows = rows.withColumn("x", F.col("v") * window)
    order = Window.partitionBy(*keys).orderBy("i")
    lagged = rows.select(*keys, "n", *[(F.col("x") * F.lag("x", k).over(order)).alias(f"p{k}") for k in range(most + 1)])
    return lagged.groupBy(*keys, "n").agg(F.array(*[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(most + 1)]).alias("auto"))


def predictors(samples: DataFrame, keys: list[str], most: int, bits: int, at: str = "at", value: str = "value") -> DataFrame:
    """keys, order, error, coefficients (whole numbers) and shift for each order of each block, 1 to `most`."""
    sums = autocorrelation(samples, keys, most, at, value)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            coefficients, errors = durbin(np.stack(pdf["auto"]))
            made = []
            for row, n in enumerate(pdf["n"]):
                for i in range(most):
                    if not np.isnan(errors[row, i]) and (whole := quantised(coefficients[row, i, : i + 1], precision(bits, n))):
                        made.append((row, i + 1, errors[row, i], *whole))
            if made:
                out = pd.DataFrame(made, columns=["row", "order", "error", "coefficients", "shift"])
                yield pd.concat([pdf[keys].iloc[out["row"]].reset_index(drop=True), out.drop(columns="row")], axis=1)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", order int, error double, coefficients array<int>, shift int")
