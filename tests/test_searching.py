"""Scans under way: what shows while they come, swaps when they end, and batches that run twice."""

from pyspark.sql import functions as F

from sonoframe.operators import intervals as I
from sonoframe.streaming import searching as W

SCHEMA = "root string, generation int, done boolean, path string, name string"


def test_a_rescan_takes_the_place_of_what_showed_when_it_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    show = lambda: sorted((r["root"], r["path"]) for r in W.shown(spark, str(tmp_path / "out")).collect())

    def send(*rows):
        spark.createDataFrame([(r, g, p is None, p, p) for r, g, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        W.start(stream, str(tmp_path / "out"), lambda: F.col("name").contains("heron")).awaitTermination()
        return show()

    assert send(("a", 1, "heron 1"), ("a", 1, "owl"), ("b", 1, "heron 9")) == [("a", "heron 1"), ("b", "heron 9")]
    assert send(("a", 1, "heron 2"), (None, 1, "heron"), ("a", None, "heron")) == [("a", "heron 1"), ("a", "heron 2"), ("b", "heron 9")]
    assert send(("a", 1, None), ("a", 2, "heron 2"), ("b", 1, None)) == [("a", "heron 1"), ("a", "heron 2"), ("b", "heron 9")]
    assert send(("a", 2, "heron 3")) == [("a", "heron 1"), ("a", "heron 2"), ("b", "heron 9")]
    assert send(("a", 2, None), ("b", 2, None)) == [("a", "heron 2"), ("a", "heron 3")]  # b is empty now
    assert send(("a", 1, "heron 8"), ("a", 1, None)) == [("a", "heron 2"), ("a", "heron 3")]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1, False, "heron", "heron"), ("a", 1, None, "heron", "heron"), ("a", 1, True, None, None)], SCHEMA)
    write = W.tried(str(tmp_path), lambda: F.col("name") == "heron")
    write(batch, 0)
    write(batch, 0)
    assert W.shown(spark, str(tmp_path)).count() == 2 and W.latest(W.shown(spark, str(tmp_path))).count() == 1


def test_points_move_into_stretches(spark):
    points = spark.createDataFrame([(1, 0), (1, 10), (1, 19), (1, 20), (1, 25), (1, 60), (2, 7), (1, None), (1, 10)], "rec_id long, frame long")
    stretches = spark.createDataFrame([(1, 10, 20), (1, 30, 60), (3, 5, 9), (1, 70, 70)], "rec_id long, lo long, hi long")
    found = sorted((r["rec_id"], r["frame"], r["moved"]) for r in I.into_stretches(points, stretches).collect())
    assert found == [(1, 0, 10), (1, 10, 10), (1, 10, 10), (1, 19, 19), (1, 20, 30), (1, 25, 30), (1, 60, 10), (2, 7, 7)]


def test_trailing_levels(spark):
    blocks = spark.createDataFrame([(1, b, float(p), float(m)) for b, p, m in ((0, 0.1, 0.01), (1, 0.9, 0.04), (3, 0.5, 0.16), (4, 0.2, 0.25))], "rec_id long, block long, peak double, mean_square double")
    points = spark.createDataFrame([(1, 5), (1, 19), (1, 35), (1, 49), (1, 500), (2, 0)], "rec_id long, frame long")
    found = {r["frame"]: (r["block"], r["peak"], round(r["rms"], 6)) for r in I.level_lookup(points, blocks, 10, 25).collect()}
    assert found == {5: (0, 0.1, 0.1), 19: (1, 0.9, round(0.025**0.5, 6)), 35: (3, 0.5, 0.4), 49: (4, 0.5, round(0.205**0.5, 6)), 500: (4, 0.5, round(0.205**0.5, 6))}
    assert {r["block"]: round(r["rms"], 6) for r in I.level_lookup(points, blocks, 10, 3).collect()}[4] == 0.5
