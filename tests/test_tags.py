"""Names, keys, dates and texts of tags on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sonoframe.operators import tags as G

FIELDS, STARTS = "rec_id long, ord int, source string, key string, value string", "rec_id long, date string, seconds double"


def pairs(spark, rule, rows):
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, key string")
    return [r["r"] for r in made.select("i", rule(F.col("kind"), F.col("key")).alias("r")).orderBy("i").collect()]


def test_labels(spark):
    rows = [("id3v2", "TIT2"), ("id3v2", "TXXX:"), ("id3v2", "COMM:a:b"), ("id3v2", "COMM"), ("mp4", "----:a:b"), ("mp4", "zzzz"), ("vorbis", "TRACK_NUMBER"), ("vorbis", ""), ("guano", "a:b"), (None, "a"), ("ape", None)]
    assert pairs(spark, G.label, rows) == ["Title", "", "a:b", "Comment", "b", "zzzz", "Track number", "", "a:b", None, None]


def test_keys(spark):
    rows = [("vorbis", "a\n"), ("ape", "a" * 255), ("ape", "a" * 256), ("id3v2", "TIT2\n"), ("id3v2", "TXXX"), ("mp4", "©nam"), ("mp4", "----::x"), ("mp4", "ab€d"), ("guano", ""), ("guano", "Loc"), ("other", "a"), ("ape", None)]
    assert pairs(spark, G.key_allowed, rows) == [False, True, False, False, False, True, False, False, False, True, False, False]


def test_dates(spark):
    rows = [
        (1, 0, "ixml", "X / BWF_ORIGINATION_DATE", "2026-05-14"), (1, 1, "ixml", "X / BWF_ORIGINATION_TIME", "21:30:05"), (2, 0, "ixml", "BWF_ORIGINATION_DATE", "2026-05-14"),
        (3, 0, "ixml", "BWF_ORIGINATION_DATE", "2026"), (4, 0, "vorbis", "dAtE", "2024"), (4, 1, "id3v2", "TDRL", "no date"), (5, 0, "id3v2", "tdrc", "2024"), (6, 0, "info", "ICRD", None),
    ]
    fields, starts = spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(3, "2025-01-02", 86401.5), (2, "nothing", 5.0)], STARTS)
    found = {r["rec_id"]: (r["start"], r["end"]) for r in G.dates_of(fields, starts).collect()}
    day = dt.datetime
    assert found == {
        1: (day(2026, 5, 14, 21, 30, 5), day(2026, 5, 14, 21, 30, 6)), 2: (day(2026, 5, 14), day(2026, 5, 15)),
        3: (day(2025, 1, 2, 0, 0, 1), day(2025, 1, 2, 0, 0, 2)), 4: (day(2024, 1, 1), day(2025, 1, 1)),
    }


def test_a_date_is_read_once(spark):
    """Filters and fields of a read date don't read it again: two patterns for each of four texts, and for starts again."""
    ids = spark.range(5)
    fields, starts = ids.selectExpr("id rec_id", "0 ord", "'ixml' || id source", "'a' || id key", "'b' || id value"), ids.selectExpr("id rec_id", "'2024' || id date", "cast(id as double) seconds")
    assert G.dates_of(fields, starts)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 10


def test_empty_tables(spark):
    assert G.dates_of(spark.createDataFrame([], FIELDS), spark.createDataFrame([], STARTS)).collect() == []


@pytest.mark.parametrize(("name", "text", "fits"), [("Date", "2024-05-01", True), ("Date", "2024-05-01x", False), ("Originator", "õ" * 16, True), ("Originator", "õ" * 16 + "a", False), ("Time", "a\nb", True), ("Other", "x" * 999, True)])
def test_bext(spark, name, text, fits):
    problem = spark.createDataFrame([(name, text)], "n string, t string").select(G.bext_problem(F.col("n"), F.col("t")).alias("p")).first()["p"]
    assert (problem is None) == fits
