"""Every registered query with an oracle against DuckDB, and every other one for rows, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from colloquy.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(rows, columns):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, columns) == plain([dict(zip(columns, r, strict=True)) for r in found.fetchall()], columns)


def test_the_library_works_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['colloquy.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'gap_merge' in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
