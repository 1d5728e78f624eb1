"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark import catalogue
from tests.conftest import SF

_QUERIES, _ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.7g}"
        return repr(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def test_each_query_has_an_oracle():
    assert set(_QUERIES) == set(_ORACLE)


@pytest.mark.parametrize("name", sorted(_QUERIES))
def test_matches_oracle(spark, duck, name):
    df = _QUERIES[name](spark, SF)
    found = duck.execute(_ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(found.fetchall(), names)
