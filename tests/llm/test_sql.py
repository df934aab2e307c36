"""The queries that SQL can say give the rows that it gives in another engine."""

import duckdb
import pytest

from sonoframe.llm import registry


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_sharding"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    frame, answer = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    order = [answer.columns.index(c) for c in frame.columns]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in answer.fetchall())
