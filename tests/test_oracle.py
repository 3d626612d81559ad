"""Every query with oracle SQL matches DuckDB (rows, column names, values)."""

import pytest

import __spark_entry__ as se
from paths import SMALL
from tools.oracle_check import rows_of

ORACLE = sorted(se.oracle_sql())
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_duckdb(spark, duck_small, name):
    sdf = se.queries()[name](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck_small.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    dtypes = dict(zip(dcols, [str(t) for t in duck_small.sql(se.oracle_sql()[name]).types]))
    assert {c: TYPES.get(t, t) for c, t in sdf.dtypes} == dtypes
    assert len(srows) == len(drows)
    a, b = rows_of(sdf.columns, srows), rows_of(dcols, drows)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert u == pytest.approx(v, rel=1e-9, abs=1e-9)
            else:
                assert u == v


def test_every_query_is_registered_with_a_docstring():
    for name, fn in se.queries().items():
        assert fn.__doc__, name


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() >= 0
    assert "auc" in df.columns
