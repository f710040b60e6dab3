import math

import pytest

from tessera.queries import ORACLE_SQL, QUERIES


def rows(names, found):
    out = []
    for r in found:
        r = dict(zip(names, r))
        out.append(tuple(r[c] for c in sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, small, name):
    df, sql = QUERIES[name](spark, small), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(list(sql.columns), sql.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
