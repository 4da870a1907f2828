"""Every core query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
CORE = [n for n in sorted(entry.oracle_sql()) if not entry.queries()[n].__module__.startswith("quire.llm")]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(SF).iterdir()):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    df, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [list(want.columns).index(c) for c in cols]
    assert Counter(tuple(map(plain, r)) for r in df.select(*cols).collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
