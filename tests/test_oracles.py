"""Every query of the reference's operators gives the rows that its SQL gives in another engine."""

import duckdb
import pytest

import sonoframe.queries  # noqa: F401
from sonoframe.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    frame = QUERIES[name](spark, sf)
    answer = con.sql(SQL[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    assert normal(frame.collect(), frame.columns) == normal(answer.fetchall(), answer.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["level_blocks", "number_running", "segments_merge", "rename_collisions", "spectrogram_max"])
def test_partitioning_changes_nothing(spark, sf, name):
    once = normal((f := QUERIES[name](spark, sf)).collect(), f.columns)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert normal((f := QUERIES[name](spark, sf)).collect(), f.columns) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
