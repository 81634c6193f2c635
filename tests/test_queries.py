"""Every query runs, and agrees with its SQL, over the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from pitspark.plans import CORE_MODULES

NAMES = sorted(n for n in entry_module.queries())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from read_parquet('{p}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
        if isinstance(x, decimal.Decimal):
            return f"{float(x):.9g}"
        return str(x) if not isinstance(x, datetime.datetime) else x.isoformat()

    return [columns[k] for k in order], sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    df = entry_module.queries()[name](spark, sf)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    sql = entry_module.oracle_sql().get(name)
    if sql is not None:
        rel = duck.sql(sql)
        assert got == plain(rel.fetchall(), list(rel.columns))
    if name.endswith("_found"):
        assert len(got[1]) == len(set(got[1]))


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0 and CORE_MODULES


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(NAMES)
