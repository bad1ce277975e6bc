"""Each query against its SQL in DuckDB."""

import math

import pytest

from somatlas import queries as q
from tests.conftest import DATA


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(v[i] for i in order) for v in values]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) if not isinstance(x, float) else (False, "n", round(x, 4)) for x in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    df = q.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = oracle.execute(q.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    bad = [(g, w) for g, w in zip(got[1], want[1]) if not all(map(same, g, w))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_other_query_runs(spark, name):
    df = q.queries()[name](spark, DATA)
    assert df.count() > 0


def test_hierarchy_has_children(spark):
    maps = q.queries()["vertical_growth"](spark, DATA).collect()
    assert len(maps) > 1 and sum(r["children"] for r in maps) == len(maps) - 1
    leaves = q.queries()["hierarchical_predict"](spark, DATA).toPandas()
    assert (leaves.map_id > 0).any() and leaves.id.is_unique


def test_stream_scoring_counts_every_event(spark, oracle):
    hits = q.queries()["stream_scoring"](spark, DATA).collect()
    assert sum(r["hits"] for r in hits) == oracle.execute("SELECT count(*) FROM events").fetchone()[0]
