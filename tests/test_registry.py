"""Every registered core query against its DuckDB SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from gleanworks import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in core.ORACLES:
        assert got
        return
    cur = duck.execute(core.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry_and_names(spark):
    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
