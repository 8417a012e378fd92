"""Every query runs on the smallest tables, with the columns of its SQL."""

from __future__ import annotations

import importlib.util
import math
import os
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__
from tracewright.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_names_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)


def plain(v):
    """Values of both engines in one form: numbers rounded, lists as tuples."""
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
        got = con.sql(sql)
        assert sorted(got.columns) == columns
        order = [got.columns.index(c) for c in columns]
        expected = Counter(plain([r[i] for i in order]) for r in got.fetchall())
        assert Counter(plain(r) for r in rows) == expected


def test_broken_module_is_shown(monkeypatch):
    """Only a missing llm folder leaves its queries out."""
    if importlib.util.find_spec("tracewright.llm") is None:
        pytest.skip("no llm folder")

    def broken(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ImportError):
        __spark_entry__.queries()
