"""Every registered query of the engine runs; those with SQL give the same rows in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera import catalog
from tessera.plans import context


def rows(frame):
    out = frame[sorted(frame.columns)]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf"
    show = lambda v: "NULL" if pd.isna(v) else repr(round(float(v), 6) + 0.0) if number(v) else str(v)
    return sorted(tuple(show(v) for v in r) for r in out.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module", autouse=True)
def packs_once():
    """The queries of context packs share their sections here; each makes its own elsewhere."""
    made, plain = {}, context._packs
    context._packs = lambda spark, d: made.get(d) or made.setdefault(d, plain(spark, d))
    yield
    context._packs = plain


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "id", "score", "rank"]
