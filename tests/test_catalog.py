"""Every registered query outside the corpus operators against the same tables in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 4)
    return str(v) if not isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    a = [tuple(canon(r[c]) for c in order) for r in got.collect()]
    at = [rel.columns.index(c) for c in order]
    b = [tuple(canon(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(a, key=repr) == sorted(b, key=repr)
