"""Every reference query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from weftline.plans import queries as Q

TABLES = "part lineitem supplier events".split()


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_stages():
    """The stages of a comparison are made once for all tests of this module."""
    make, kept = Q.comparison, {}
    Q.comparison = lambda spark, sf_dir, model="raw": kept.setdefault((sf_dir, model), make(spark, sf_dir, model))
    yield
    Q.comparison = make


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    shown = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query(spark, small, tables, name):
    got = Q.QUERIES[name](spark, small)
    want = tables.execute(Q.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE)


def test_the_entry_stands_without_the_other_subpackage():
    import subprocess
    import sys

    code = "import builtins; f = builtins.__import__\n"
    code += "def g(name, *a, **b):\n    if name.startswith('weftline.llm'): raise ImportError(name)\n    return f(name, *a, **b)\n"
    code += "builtins.__import__ = g\nimport __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True, check=True).stdout) == len(Q.ORACLE)
