"""A search over scans of folders that are still under way: new rows are tried once, finished rescans replace what showed.

Scans arrive as a stream of rows (root, generation, done, and the catalog's columns): one for each file that a scan
found, and one with `done` for a scan's end. A root's generations count its scans. What a scan finds shows at once
while none of its root has ended; a later scan's rows wait, and when it ends they take the place of all earlier ones.

Each micro-batch writes the rows that the search admits, and the scans that ended, under its own number, so a batch that
runs again after a failure writes the same files again. What shows is a join with the newest ended scan of each root:
nothing is rewritten, and no state grows in the stream.

Defined results: rows without a root or generation are left out; a scan that ends twice, or rows that come after its
end, change nothing or show at once; a scan that ends while a later one has ended stays hidden; an ended scan without rows
empties its root; rows that come again are rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tried(target: str, condition: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the search is tried on a batch's rows only; what it admits, and what began and ended, is kept at `target`."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("root is not null and generation is not null")
        rows.where(~F.coalesce("done", F.lit(False)) & condition()).drop("done").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        seen = rows.groupBy("root", "generation").agg(F.coalesce(F.bool_or("done"), F.lit(False)).alias("done"))
        seen.write.mode("overwrite").parquet(f"{target}/scans/batch={number}")

    return write


def start(scans: DataFrame, target: str, condition: Callable[[], Column]) -> StreamingQuery:
    """Tries all that has come so far, batch by batch, and ends; a later call goes on where this one ended."""
    writer = scans.writeStream.foreachBatch(tried(target, condition)).option("checkpointLocation", f"{target}/checkpoint")
    return writer.trigger(availableNow=True).start()


def shown(spark: SparkSession, target: str) -> DataFrame:
    """The admitted rows of the scan that each root shows: the newest that ended, or else the first."""
    scans = spark.read.parquet(f"{target}/scans").groupBy("root", "generation").agg(F.bool_or("done").alias("done"))
    which = F.coalesce(F.max(F.when(F.col("done"), F.col("generation"))), F.min("generation"))
    current = scans.groupBy("root").agg(which.alias("generation"))
    return spark.read.parquet(f"{target}/rows").drop("batch").join(current, ["root", "generation"])


def latest(found: DataFrame, path: str = "path") -> DataFrame:
    """One row for each path, for scans that may send a file twice."""
    first = Window.partitionBy("root", path).orderBy(*[F.col(f"`{c}`") for c in found.columns if c not in ("root", path)])
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
