"""Queries that SQL can express, against DuckDB over the driver's tables."""

import pytest

from somatlas.llm import queries as q
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    df = q.queries()[name](spark, DATA)
    cur = oracle.execute(q.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    key = lambda r: tuple(map(str, r))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:2]
